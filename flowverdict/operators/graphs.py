"""Call graphs as edge tables ``(trace_id, pos, from_id, to_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import CALL_GRAPH
from .ordering import PART_ROWS, in_order


def call_edges(requests: DataFrame, dedup: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """One edge per pair of successive requests of a capture.

    With ``dedup`` only the first occurrence of each (from, to) is kept.
    """
    order = ["seq"] if "seq" in requests.columns else ["ts", "pkt_no"]
    slim = requests.select("trace_id", *order, "path")
    edges = (
        in_order(slim, ["trace_id"], order, index="pos", following={"to_id": "path"},
                 part_rows=part_rows)
        .where(F.col("to_id").isNotNull())
        .select("trace_id", "pos", F.col("path").alias("from_id"), "to_id")
    )
    if not dedup:
        return edges
    return edges.groupBy("trace_id", "from_id", "to_id").agg(F.min("pos").alias("pos")).select(
        "trace_id", "pos", "from_id", "to_id"
    )


def explode_graphs(graphs: DataFrame, id_col: str = "_id") -> DataFrame:
    """Edge table of rows that hold a ``call_graph`` array."""
    return graphs.select(
        F.col(id_col).alias("trace_id"), F.posexplode("call_graph").alias("pos", "edge")
    ).select(
        "trace_id", F.col("pos").cast("long").alias("pos"),
        F.col("edge.fromId").alias("from_id"), F.col("edge.toId").alias("to_id"),
    )


def collect_graphs(edges: DataFrame) -> DataFrame:
    """Rows with a ``call_graph`` array in edge order, for export and messages.

    The array is the record format, so one record must fit one task. Scoring does not
    go through here; it works on edge tables.
    """
    packed = F.array_sort(
        F.collect_list(F.struct("pos", F.col("from_id").alias("fromId"),
                                F.col("to_id").alias("toId")))
    )
    return edges.groupBy("trace_id").agg(packed.alias("_edges")).select(
        F.col("trace_id").alias("_id"),
        F.transform(
            "_edges", lambda e: F.struct(e["fromId"].alias("fromId"), e["toId"].alias("toId"))
        ).cast(CALL_GRAPH).alias("call_graph"),
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """Out-degree, in-degree and their sum ``x`` per node; parallel edges count."""
    ends = edges.select(
        "trace_id",
        F.explode(
            F.array(
                F.struct(F.col("from_id").alias("node_id"), F.lit(1).alias("o"),
                         F.lit(0).alias("i")),
                F.struct(F.col("to_id").alias("node_id"), F.lit(0).alias("o"),
                         F.lit(1).alias("i")),
            )
        ).alias("end"),
    )
    degrees = ends.groupBy("trace_id", F.col("end.node_id").alias("node_id")).agg(
        F.sum("end.o").alias("out_degree"), F.sum("end.i").alias("in_degree")
    )
    return degrees.withColumn(
        "x", (F.col("out_degree") + F.col("in_degree")).cast("double")
    )


def all_nodes(edges: DataFrame) -> DataFrame:
    ends = [edges.select("trace_id", F.col(end).alias("node_id")) for end in ("from_id", "to_id")]
    return ends[0].union(ends[1]).distinct()


def graph_nodes(edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Distinct nodes per graph, numbered in lexical order."""
    return in_order(all_nodes(edges), ["trace_id"], ["node_id"], index="node_index",
                    part_rows=part_rows)


def graph_statistics(edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Edges, nodes and distinct ends per graph; zeros for graphs without edges.

    ``graphs`` lists all trace ids; without it only graphs with edges appear.
    """
    counted = node_degrees(edges).groupBy("trace_id").agg(
        F.sum("out_degree").alias("edge_count"),
        F.count(F.lit(1)).alias("node_count"),
        F.count(F.when(F.col("out_degree") > 0, 1)).alias("unique_from"),
        F.count(F.when(F.col("in_degree") > 0, 1)).alias("unique_to"),
    )
    if graphs is None:
        return counted
    return graphs.select("trace_id").join(counted, "trace_id", "left").fillna(0)


def topology_features(edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """Density, largest in-degree and mean clustering of the simple graph.

    Self-loops and repeated edges are left out. In-degrees, neighbour counts and triangles
    are gathered as rows per node and meet in two grouped sums, without joins.
    """
    sides = _sides(edges)
    zero = F.lit(0)
    ends = sides.select("trace_id", F.col("node").alias("node_id"), "i", "k", zero.alias("t"))
    corners = _triangle_corners(sides).select(
        "trace_id", "node_id", zero.alias("i"), zero.alias("k"), F.lit(1).alias("t")
    )
    nodes = ends.unionByName(corners).groupBy("trace_id", "node_id").agg(
        F.sum("i").alias("i"), F.sum("k").alias("k"), F.sum("t").alias("t")
    )
    local = F.when(F.col("k") > 1, 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1)))
    v = F.count(F.lit(1))
    out = nodes.groupBy("trace_id").agg(
        F.when(v > 1, F.sum("i") / (v * (v - 1))).otherwise(F.lit(0.0)).alias("graph_density"),
        F.max("i").cast("double").alias("max_in_degree"),
        (F.sum(F.coalesce(local, F.lit(0.0))) / v).alias("avg_clustering"),
    )
    if graphs is None:
        return out
    return graphs.select("trace_id").join(out, "trace_id", "left").fillna(0.0)


def _sides(edges: DataFrame) -> DataFrame:
    """Both ends of every undirected edge: (trace_id, a, b, node, i, k), node being a or b.

    ``i`` tells whether an edge leads to this node from the other end, ``k`` whether the
    ends differ. The explicit exchange is where all readers of the edges meet: they share
    its output, so the ordered pass over the requests runs once. Self-loops stay in until
    later, because a filter here would sink below the exchange in one reader only.
    """
    a, b = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    undirected = (
        edges.select("trace_id", "from_id", "to_id", a.alias("a"), b.alias("b"))
        .groupBy("trace_id", "a", "b")
        .agg(
            F.max(((F.col("to_id") == F.col("a")) & (F.col("a") != F.col("b"))).cast("int"))
            .alias("into_a"),
            F.max(((F.col("to_id") == F.col("b")) & (F.col("a") != F.col("b"))).cast("int"))
            .alias("into_b"),
        )
        .repartition("trace_id", "a", "b")
    )
    differ = (F.col("a") != F.col("b")).cast("int").alias("k")
    return undirected.select("trace_id", "a", "b", F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.col("into_a").alias("i"), differ),
        F.struct(F.col("b").alias("node"), F.col("into_b").alias("i"), differ),
    )))


def _triangle_corners(sides: DataFrame) -> DataFrame:
    """One row per corner of every triangle.

    Each edge is turned towards its end of higher degree, so a node opens pairs only over
    its few edges to higher nodes and a hub opens none over its many edges from lower ones.
    """
    degree = sides.groupBy("trace_id", "node").agg(F.sum("k").alias("k"))
    end = F.struct("k", "node")
    ends = sides.drop("i", "k").join(degree, ["trace_id", "node"])
    turned = ends.groupBy("trace_id", "a", "b").agg(
        F.min(end).alias("low"), F.max(end).alias("high")
    )
    turned = turned.where(F.col("low.node") != F.col("high.node")).select(
        "trace_id", F.col("low.node").alias("src"), "high"
    )
    first = turned.select("trace_id", "src", F.col("high").alias("h1"))
    second = turned.select("trace_id", "src", F.col("high").alias("h2"))
    wedges = first.join(second, ["trace_id", "src"]).where(F.col("h1") < F.col("h2"))
    closing = turned.select("trace_id", F.col("src").alias("n1"), F.col("high.node").alias("n2"))
    triangles = wedges.select(
        "trace_id", "src", F.col("h1.node").alias("n1"), F.col("h2.node").alias("n2")
    ).join(closing, ["trace_id", "n1", "n2"])
    return triangles.select("trace_id", F.explode(F.array("src", "n1", "n2")).alias("node_id"))


def label_graphs(graphs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Graphs that have a label and at least one node. ``labelled``: (_id, y)."""
    return graphs.where(F.size("call_graph") > 0).join(labelled.select("_id", "y"), "_id")


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (from, to) per graph with the number of parallel edges ``n``.

    The exchange lets all readers of the pairs share one ordered pass over the requests,
    and spreads a large graph over many tasks.
    """
    counted = edges.groupBy("trace_id", "from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.repartition("trace_id", "from_id", "to_id")


def gcn_propagate(nodes: DataFrame, edges: DataFrame, value: str = "x") -> DataFrame:
    """One normalised neighbour sum of ``value`` over each graph.

    Every node has exactly one self-loop; parallel edges add; a message goes from ->
    to, scaled by 1/sqrt(d_from * d_to), d being the in-degree with the self-loop.
    """
    pairs = weighted_pairs(edges).where(F.col("from_id") != F.col("to_id"))
    in_degree = pairs.groupBy("trace_id", F.col("to_id").alias("node_id")).agg(
        F.sum("n").alias("n_in")
    )
    scaled = nodes.join(in_degree, ["trace_id", "node_id"], "left").select(
        "trace_id", "node_id",
        F.sqrt(F.coalesce("n_in", F.lit(0)) + 1.0).alias("root"),
        (F.col(value) / F.sqrt(F.coalesce("n_in", F.lit(0)) + 1.0)).alias("sent"),
    )
    incoming = (
        pairs.join(
            scaled.select("trace_id", F.col("node_id").alias("from_id"), "sent"),
            ["trace_id", "from_id"],
        )
        .groupBy("trace_id", F.col("to_id").alias("node_id"))
        .agg(F.sum(F.col("n") * F.col("sent")).alias("received"))
    )
    return scaled.join(incoming, ["trace_id", "node_id"], "left").select(
        "trace_id", "node_id",
        ((F.coalesce("received", F.lit(0.0)) + F.col("sent")) / F.col("root"))
        .alias("propagated"),
    )
