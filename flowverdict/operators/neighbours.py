"""Exact nearest neighbours of vectors by a metric partition.

Some of the vectors are pivots, about one for every ``CELL_ROWS``; a vector belongs to a near
pivot, and the vectors of a pivot form blocks of bounded size, so their number grows with the
table. Each block finds neighbours among its own vectors; the distance of the k-th one bounds how
far the true neighbours can lie. By the triangle inequality a vector then visits only the blocks
whose pivot is nearer than that bound and the block's radius. Copies of a vector count once here,
with their number, so no block is filled by copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import checkpointed

CELL_ROWS = 4000
REGIONS = 1024  # pivots of the first level at most: what the driver holds and the tasks get
MOST_TASKS = 2000  # of one step
VISITS_PER_GROUP = 8_000  # vectors that meet a block in one go: a few kB of Python each
SLACK = 1e-9  # for sums that round differently
_NEAR = "array<struct<d: double, x: array<double>, m: bigint>>"


def _rows(column) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j : j + 1] - b[:, j]) ** 2
    return out


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def _regions(vectors: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``(x, m, region)``: the nearest of at most ``REGIONS`` vectors, which are given as well."""
    many = int(min(REGIONS, max(1, np.ceil(np.sqrt(n / CELL_ROWS)))))
    first = vectors.orderBy(F.xxhash64("x"), "x").limit(many).select("x").collect()
    centres = np.array([r["x"] for r in first], float)

    def nearest(batches):
        for batch in batches:
            x = _rows(batch.column("x"))
            at = [_squares(x[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(x), 4096)]
            yield batch.append_column("region", pa.array(np.concatenate([np.zeros(0, int), *at]), pa.int64()))

    return vectors.select("x", "m").mapInArrow(nearest, "x array<double>, m bigint, region bigint"), centres


def _placed(vectors: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``(x, m, region, pivot, far, block)`` of every vector, and the centres of the regions.

    The pivots of a region are its vectors whose hash says so, one of about ``CELL_ROWS``, and
    its centre. A region of very many vectors is dealt into groups, each of which gets its pivots.
    """
    rows, centres = _regions(vectors, n)
    rows = checkpointed(rows)
    spark = vectors.sparkSession
    middle = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "region long, pivot array<double>")
    drawn = rows.where(F.pmod(F.xxhash64("x", F.lit(7)), F.lit(CELL_ROWS)) == 0).select(
        "region", F.col("x").alias("pivot"))
    pivots = middle.unionByName(drawn).distinct()
    crowd = rows.groupBy("region").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(VISITS_PER_GROUP)).alias("groups"))
    dealt = rows.join(crowd, "region").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("groups"))).drop("groups")
    hosts = pivots.join(crowd, "region").select(
        "region", "pivot", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _PLACED})
        x, p = _rows(left["x"]), _rows(right["pivot"])
        step = max(1, (1 << 22) // len(p))
        found = [_squares(x[k : k + step], p) for k in range(0, len(x), step)]
        at = np.concatenate([d.argmin(axis=1) for d in found])
        return pa.table({
            "x": left["x"], "m": left["m"], "region": left["region"],
            "pivot": right["pivot"].combine_chunks().take(pa.array(at)),
            "far": pa.array(np.sqrt(np.concatenate([d.min(axis=1) for d in found]))),
        })

    placed = checkpointed(dealt.groupBy("region", "salt").cogroup(hosts.groupBy("region", "salt")).applyInArrow(
        nearest, "x array<double>, m bigint, region bigint, pivot array<double>, far double"))
    sizes = placed.groupBy("region", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).alias("parts"))
    part = F.pmod(F.xxhash64("x", F.lit(3)), F.col("parts"))
    return placed.join(sizes, ["region", "pivot"]).withColumn(
        "block", F.xxhash64("region", "pivot", part)).drop("parts"), centres


_PLACED = [("x", pa.list_(pa.float64())), ("m", pa.int64()), ("region", pa.int64()),
           ("pivot", pa.list_(pa.float64())), ("far", pa.float64())]


def _nearest(queries, points, k, skip_self, chunk=256):
    """Indices and squared distances of the k nearest points, nearest first."""
    k = min(k + skip_self, len(points))
    for lo in range(0, len(queries), chunk):
        q = queries[lo : lo + chunk]
        d = np.zeros((len(q), len(points)))
        for j in range(q.shape[1]):
            d += (q[:, j : j + 1] - points[:, j]) ** 2
        if skip_self:
            d[np.arange(len(q)), lo + np.arange(len(q))] = np.inf
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        dist = np.take_along_axis(d, best, axis=1)
        order = np.argsort(dist, axis=1, kind="stable")
        yield lo, np.take_along_axis(best, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _packed(best, dist, points, copies, k):
    return [
        [{"d": float(dd), "x": points[i], "m": int(copies[i])}
         for i, dd in zip(b, ds) if np.isfinite(dd)][:k]
        for b, ds in zip(best, dist)
    ]


def nearest_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors``: distinct ``x`` with copies ``m``. Adds ``near``: the k nearest other
    vectors with distance and copies, nearest first."""
    n = vectors.count()
    whole = n <= CELL_ROWS
    placed = vectors.select("x", "m", F.lit(0).cast("long").alias("block"))
    if not whole:
        placed, centres = _placed(vectors, n)
        placed = checkpointed(placed)

    def inside(pdf):
        x, m = np.stack(pdf["x"].to_numpy()), pdf["m"].to_numpy()
        near: list = []
        if len(x) > 1:
            for _, best, dist in _nearest(x, x, k, 1):
                near += _packed(best, dist, x, m, k)
        else:
            near = [[]]
        pdf["near"] = near
        pdf["reach"] = [np.sqrt(v[k - 1]["d"]) if len(v) >= k else np.inf for v in near]
        return pdf

    dealt = placed.select("x", "m", "block")
    if not whole:  # a block is little data and much work, so tasks follow the blocks, not the bytes
        dealt = dealt.repartition(_tasks(n / CELL_ROWS), "block")
    local = dealt.groupBy("block").applyInPandas(
        inside, f"x array<double>, m bigint, block bigint, near {_NEAR}, reach double"
    )
    if whole:
        return local.select("x", "m", "near")
    local = checkpointed(local)

    # A block reaches a region, and then its blocks, by distances of pivots alone.
    blocks = checkpointed(placed.groupBy("block", "region", "pivot").agg(F.max("far").alias("radius")).join(
        local.groupBy("block").agg(F.max("reach").alias("reach")), "block"))
    sizes = placed.select("region", "x").mapInArrow(
        _far_from(centres), "region bigint, far double").groupBy("region").agg(F.max("far").alias("far")).collect()
    outer = np.full(len(centres), -np.inf)
    for r in sizes:  # one row for each of at most ``REGIONS`` regions
        outer[r["region"]] = r["far"]

    def regions(batches):
        for batch in batches:
            p = _rows(batch.column("pivot"))
            span = np.asarray(batch.column("radius")) + np.asarray(batch.column("reach"))
            for at in range(0, len(p), 4096):
                far = np.sqrt(_squares(p[at : at + 4096], centres))
                row, region = np.nonzero(far * (1 - SLACK) <= span[at : at + 4096, None] + outer[None, :] + SLACK)
                yield batch.take(pa.array(at + row)).append_column("to", pa.array(region, pa.int64()))

    asks = blocks.select("block", "pivot", "radius", "reach").mapInArrow(
        regions, "block bigint, pivot array<double>, radius double, reach double, to bigint")
    host = blocks.select(F.col("region").alias("to"), F.col("block").alias("cell"),
                         F.col("pivot").alias("host"), F.col("radius").alias("host_radius"))
    apart = _distance(F.col("pivot"), F.col("host")) * F.lit(1 - SLACK)
    pairs = asks.join(host, "to").where(
        (F.col("block") != F.col("cell"))
        & (apart <= F.col("radius") + F.col("reach") + F.col("host_radius") + F.lit(SLACK))
    ).select("block", "cell", "host", "host_radius")
    own = _distance(F.col("x"), F.col("host")) * F.lit(1 - SLACK)
    asked = local.select("x", "reach", "block").join(pairs, "block").where(
        own <= F.col("reach") + F.col("host_radius") + F.lit(SLACK)).select("x", "reach", "cell")
    asked = checkpointed(asked)
    visits = asked.count()
    placed = placed.select("x", "m", F.col("block").alias("cell"))
    # A cell that very many vectors visit is split into groups of bounded size.
    crowd = asked.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(VISITS_PER_GROUP)).alias("groups")
    )
    asked = asked.join(crowd, "cell").withColumn(
        "salt", F.pmod(F.xxhash64("x"), F.col("groups"))
    ).select("x", "reach", "cell", "salt")
    hosts = placed.join(crowd, "cell").select(
        "x", "m", "cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")
    )

    tasks = _tasks(visits / VISITS_PER_GROUP)
    asked, hosts = (df.repartition(tasks, "cell", "salt") for df in (asked, hosts))

    def visit(left, right):
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"x": [], "near": []})
        q = np.stack(left["x"].to_numpy())
        x, m = np.stack(right["x"].to_numpy()), right["m"].to_numpy()
        near: list = []
        reach = left["reach"].to_numpy() ** 2 * (1 + SLACK)
        for lo, best, dist in _nearest(q, x, k, 0):
            # What lies beyond the k-th of the own block is none of the k nearest.
            dist[dist > reach[lo : lo + len(dist), None]] = np.inf
            near += _packed(best, dist, x, m, k)
        out = pd.DataFrame({"x": left["x"], "near": near})
        return out[[len(v) > 0 for v in near]]

    remote = asked.groupBy("cell", "salt").cogroup(hosts.groupBy("cell", "salt")).applyInPandas(
        visit, f"x array<double>, near {_NEAR}"
    )
    both = local.select("x", "m", "near").unionByName(
        remote.select("x", F.lit(None).cast("bigint").alias("m"), "near")
    )
    merged = both.groupBy("x").agg(
        F.max("m").alias("m"), F.flatten(F.collect_list("near")).alias("near")
    )
    return merged.select("x", "m", F.slice(F.array_sort("near"), 1, k).alias("near"))


def _tasks(groups: float) -> int:
    """Partitions for ``groups`` groups of full size."""
    return int(min(MOST_TASKS, max(1, np.ceil(groups))))


def _far_from(centres: np.ndarray):
    """Distance of every vector to the centre of its region."""
    def far(batches):
        for batch in batches:
            x, region = _rows(batch.column("x")), np.asarray(batch.column("region"))
            yield pa.RecordBatch.from_pydict({
                "region": batch.column("region"), "far": np.sqrt(((x - centres[region]) ** 2).sum(axis=1))})

    return far
