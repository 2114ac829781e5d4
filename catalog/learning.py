"""Queries on preparation, models, scores and explanations."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowverdict.functions import records
from flowverdict.operators import (
    explain as ex, forest as fo, gate as gt, gcn, graphs as g, joins as j, prepare as pr,
    smote as sm,
)
from flowverdict.operators.lineage import checkpointed
from flowverdict.operators.graph_batch import initial_weights
from flowverdict.plans import compare, detect, train
from flowverdict.schemas import MODEL_INPUT, NUMERIC, c
from flowverdict.sources import tables as t

from .registry import query, rounded
from .traffic import features
from .views import VIEWS, sql

_MODELS: dict = {}


def graph_rows(spark, folder):
    return g.collect_graphs(g.call_edges(t.requests(spark, folder)))


def labelled_sessions(spark, folder):
    """Session features with a class: sessions with at least three errors in ten events
    are outliers."""
    share = t.packets(spark, folder).groupBy(F.col("trace_id").alias("_id")).agg(
        F.avg((F.col("event_type") == "error").cast("double")).alias("share")
    )
    kind = F.when(F.col("share") >= 0.3, "outlier").otherwise("normal")
    out = features(spark, folder).join(share, "_id").withColumn("classification", kind)
    return out.drop("share").withColumn("y", records.label(F.col("classification")))


class FolderModels:
    """Models fitted on the sessions of a folder, each when it is first asked for."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    @cached_property
    def rows(self):
        return labelled_sessions(self.spark, self.folder)

    @cached_property
    def forest(self):
        return fo.train_forest(self.rows)

    @cached_property
    def graphs(self):
        return checkpointed(
            graph_rows(self.spark, self.folder).join(self.rows.select("_id", "y"), "_id"))

    @cached_property
    def gcn(self):
        return gcn.fit_gcn(self.graphs, pos_weight="balanced")

    @cached_property
    def fallback(self):
        return gcn.fit_gcn(self.graphs, depth=1, pos_weight="balanced")


def models(spark, folder):
    """Models of the folder, once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _MODELS:
        _MODELS[key] = FolderModels(spark, folder)
    return _MODELS[key]


# --- Preparation ---------------------------------------------------------------------


@query("fit_label_codes", sql("""
    SELECT 'ip_type' AS "column", v AS value, row_number() OVER (ORDER BY v) - 1 AS code
    FROM (SELECT DISTINCT ip_type AS v FROM dirty WHERE ip_type IS NOT NULL)
    UNION ALL SELECT 'source', v, row_number() OVER (ORDER BY v) - 1
    FROM (SELECT DISTINCT source AS v FROM dirty)"""))
def fit_label_codes(spark, folder):
    return pr.fit_label_codes(t.dirty_features(spark, folder))


@query("apply_label_codes", sql("""
    SELECT _id, CASE ip_type WHEN 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS ip_type,
           CASE source WHEN 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS source FROM dirty"""))
def apply_label_codes(spark, folder):
    """Codes of lines that are not returned as N: N is unseen and becomes 0."""
    rows = t.dirty_features(spark, folder)
    codes = pr.fit_label_codes(rows.where(F.coalesce(F.col("ip_type"), F.lit("")) != "N"))
    return pr.apply_label_codes(rows, codes).select("_id", "ip_type", "source")


_LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]


def _lines(spark, folder):
    return t.table(spark, folder, "lineitem").withColumn("constant", F.lit(7.0))


@query("fit_scaler", sql(" UNION ALL ".join(
    f"""SELECT '{n}' AS "column", round(avg({n}), 4) AS mean,
        round(CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END, 4) AS scale
        FROM lines""" for n in _LINES), lines="SELECT *, 7.0::DOUBLE AS constant FROM lineitem"))
def fit_scaler(spark, folder):
    return rounded(pr.scaler_statistics(_lines(spark, folder), _LINES), 4)


@query("apply_scaler", sql(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
        f"""round(({n} - (SELECT avg({n}) FROM lines)) / (SELECT
            CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END FROM lines), 6)
            + 0.0 AS {n}""" for n in _LINES) + " FROM lines",
    lines="SELECT *, 7.0::DOUBLE AS constant FROM lineitem"))
def apply_scaler(spark, folder):
    rows = _lines(spark, folder)
    out = pr.apply_scaler(rows, pr.fit_scaler(rows, _LINES))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_LINES))


def _code_sql(name):
    """Code of a category: how many of its values sort before it."""
    value = f"coalesce({name}, 'unknown')"
    return (f"(SELECT count(*) FROM (SELECT DISTINCT {value} AS v FROM dirty) WHERE v < coalesce(d.{name}, 'unknown'))"
            "::DOUBLE")


@query("assemble", sql("SELECT _id, " + ", ".join(
    (f"CASE WHEN n{k + 1} IS NULL OR isnan(n{k + 1}) OR isinf(n{k + 1}) THEN 0.0 ELSE n{k + 1} END::DOUBLE"
     if n in NUMERIC else _code_sql(n)) + f" AS x{k}" for k, n in enumerate(MODEL_INPUT)) + " FROM dirty d"))
def assemble(spark, folder):
    """The parts of the assembled vector, each as a column."""
    rows = records.clean_features(t.dirty_features(spark, folder))
    out = pr.assemble(pr.apply_label_codes(rows, pr.fit_label_codes(rows)))
    parts = vector_to_array("features")
    return out.select("_id", *[F.get(parts, F.lit(k)).alias(f"x{k}") for k in range(len(MODEL_INPUT))])


@query("stratified_split", sql("""
    SELECT _id, y, (rank >= round(n * 0.6))::INTEGER + (rank >= round(n * (0.6::DOUBLE + 0.2)))
           ::INTEGER AS part
    FROM (SELECT _id, y, count(*) OVER (PARTITION BY y) AS n,
                 row_number() OVER (PARTITION BY y ORDER BY md5(_id || '-42'), _id) - 1 AS rank
          FROM (SELECT event_id::VARCHAR AS _id, event_type AS y FROM events))"""))
def stratified_split(spark, folder):
    """Events by type, 60/20/20."""
    rows = t.table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("_id"), F.col("event_type").alias("y")
    )
    return pr.stratified_split(rows, [0.6, 0.2, 0.2], "_id", "y")


@query("smote")
def smote(spark, folder):
    """The balanced vectors, given and made."""
    return sm.smote(t.vectors(spark, folder)).select("_id", "y", "x")


@query("smote_balance", sql("""
    SELECT y, (SELECT max(n) FROM (SELECT count(*) AS n FROM vectors GROUP BY y)) AS rows
    FROM (SELECT DISTINCT y FROM vectors)"""))
def smote_balance(spark, folder):
    return sm.smote(t.vectors(spark, folder)).groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


# --- Forest --------------------------------------------------------------------------


@query("score_forest")
def score_forest(spark, folder):
    return models(spark, folder).forest(features(spark, folder)).select("_id", "rf_prob")


@query("feature_importances")
def feature_importances(spark, folder):
    return fo.feature_importances(models(spark, folder).forest, spark)


def _split(spark, folder, rows):
    return pr.parts_of(pr.stratified_split(rows, [0.6, 0.2, 0.2], "_id", "y"), 3)


@query("search_forest")
def search_forest(spark, folder):
    train, val, _ = _split(spark, folder, t.vectors(spark, folder))
    return fo.search_forest(train, val)


# --- Graph net -----------------------------------------------------------------------


def _matrix(values):
    return "[" + ", ".join(
        _matrix(v) if hasattr(v, "__len__") else f"{float(v)!r}::DOUBLE" for v in values) + "]"


_LINKS = """SELECT trace_id, from_id, to_id, count(*) AS n FROM edges
            WHERE from_id <> to_id GROUP BY 1, 2, 3"""
_SCALED = """SELECT g.trace_id, g.node_id, (out_degree + in_degree)::DOUBLE AS x,
             1.0 + coalesce((SELECT sum(n) FROM links l WHERE l.trace_id = g.trace_id
                 AND l.to_id = g.node_id), 0) AS d FROM degrees g"""


def _gcn_views(weights, name="prob", to=""):
    """View ``name`` (trace_id, gcn_prob) and what it needs, by unnested components: no list
    arithmetic beyond lookups by index. ``to`` keeps the views of two nets apart."""
    extra = {"links": _LINKS, "scaled": _SCALED,
             f"{to}h0": "SELECT trace_id, node_id, d, 1 AS i, x AS v FROM scaled"}
    for k, (w, b) in enumerate(weights.layers):
        extra[f"{to}a{k}"] = f"""
            SELECT trace_id, node_id, d, i, sum(v) AS v FROM (
                SELECT trace_id, node_id, d, i, v / d AS v FROM {to}h{k}
                UNION ALL
                SELECT t.trace_id, t.node_id, t.d, s.i, l.n * s.v / sqrt(s.d * t.d)
                FROM links l
                JOIN {to}h{k} s ON s.trace_id = l.trace_id AND s.node_id = l.from_id
                JOIN scaled t ON t.trace_id = l.trace_id AND t.node_id = l.to_id)
            GROUP BY 1, 2, 3, 4"""
        extra[f"{to}w{k}"] = f"""
            SELECT i, o, {_matrix(w)}[i][o] AS w, {_matrix(b)}[o] AS b
            FROM range(1, {w.shape[0] + 1}) AS x(i) CROSS JOIN range(1, {w.shape[1] + 1}) AS y(o)"""
        extra[f"{to}h{k + 1}"] = f"""
            SELECT trace_id, node_id, d, o AS i, greatest(0.0, sum(v * w) + any_value(b)) AS v
            FROM {to}a{k} JOIN {to}w{k} USING (i) GROUP BY 1, 2, 3, 4"""
    last = f"{to}h{len(weights.layers)}"
    extra[name] = f"""
        SELECT trace_id, 1.0 / (1.0 + exp(-z)) AS gcn_prob FROM (
            SELECT trace_id, {weights.head[1]!r}::DOUBLE
                   + sum(v * {_matrix(weights.head[0])}[i]) / count(DISTINCT node_id) AS z
            FROM {last} GROUP BY trace_id)"""
    return extra


def _gcn_sql(weights):
    return sql("SELECT trace_id, round(gcn_prob, 6) AS gcn_prob FROM prob", **_gcn_views(weights))


@query("score_gcn_1_layer", _gcn_sql(initial_weights(64, 1)))
def score_gcn_1_layer(spark, folder):
    return rounded(gcn.score_edges(g.call_edges(t.requests(spark, folder)), initial_weights(64, 1)))


@query("score_gcn_2_layers", _gcn_sql(initial_weights(64, 2)))
def score_gcn_2_layers(spark, folder):
    return rounded(gcn.score_edges(g.call_edges(t.requests(spark, folder)), initial_weights(64, 2)))


@query("score_gcn_large_graphs", _gcn_sql(initial_weights(64, 2)))
def score_gcn_large_graphs(spark, folder):
    """The form for graphs that fit no task, here for all graphs."""
    edges = g.call_edges(t.requests(spark, folder))
    return rounded(gcn.score_pairs_joined(g.weighted_pairs(edges), initial_weights(64, 2)))


@query("fit_gcn")
def fit_gcn(spark, folder):
    """Scores of the fitted nets of both depths."""
    m = models(spark, folder)
    rows = gcn.score_call_graphs(graph_rows(spark, folder), m.gcn, name="gcn2")
    return gcn.score_call_graphs(rows, m.fallback, name="gcn1").drop("call_graph")


@query("search_gcn")
def search_gcn(spark, folder):
    rows = graph_rows(spark, folder).join(
        labelled_sessions(spark, folder).select("_id", "y"), "_id")
    train, val, _ = _split(spark, folder, rows)
    return gcn.search_gcn(train, val)


@query("search_epochs")
def search_epochs(spark, folder):
    rows = graph_rows(spark, folder).join(
        labelled_sessions(spark, folder).select("_id", "y"), "_id")
    train, val, _ = _split(spark, folder, rows)
    return gcn.search_epochs(train, val)[0]


# --- Gate ----------------------------------------------------------------------------


def _gate_sql(gate):
    extra = {"g0": """
        SELECT trace_id, rf, gcn, y, unnest([rf, gcn, conf_rf, conf_gcn]) AS v,
               unnest([1, 2, 3, 4]) AS i FROM judged"""}
    for k, (w, b) in enumerate(gate):
        extra[f"w{k}"] = f"""
            SELECT i, o, {_matrix(w)}[i][o] AS w, {_matrix(b)}[o] AS b
            FROM range(1, {w.shape[0] + 1}) AS x(i) CROSS JOIN range(1, {w.shape[1] + 1}) AS y(o)"""
        unit = "sum(v * w) + any_value(b)"
        value = unit if k == len(gate) - 1 else f"greatest(0.0, {unit})"
        extra[f"g{k + 1}"] = f"""
            SELECT trace_id, rf, gcn, y, o AS i, {value} AS v FROM g{k} JOIN w{k} USING (i)
            GROUP BY 1, 2, 3, 4, 5"""
    return sql(f"""
        SELECT trace_id, round(a, 6) AS alpha, round(a * rf + (1.0 - a) * gcn, 6) AS gate_prob
        FROM (SELECT *, 1.0 / (1.0 + exp(-v)) AS a FROM g{len(gate)})""", **extra)


@query("score_gate", _gate_sql(gt.initial_gate(gt.NETS["small"])))
def score_gate(spark, folder):
    out = gt.score_gate(t.scores(spark, folder), gt.initial_gate(gt.NETS["small"]))
    return rounded(out.select("trace_id", "alpha", "gate_prob"))


@query("fit_gate")
def fit_gate(spark, folder):
    rows = t.scores(spark, folder)
    gate = gt.fit_gate(rows)
    return gt.score_gate(rows, gate).select("trace_id", "alpha", "gate_prob", "gate_verdict")


# --- Explanations --------------------------------------------------------------------

_IMPORTANCE = """SELECT trace_id, pkt_no AS pos, path, value - 20 AS importance
                 FROM packets JOIN events ON event_id = pkt_no"""


def _importances(spark, folder):
    """Event values stand for edge importances; some are below 0."""
    value = t.table(spark, folder, "events").select(
        F.col("event_id").alias("pkt_no"), (F.col("value") - 20).alias("importance")
    )
    return t.requests(spark, folder).join(value, "pkt_no").select(
        "trace_id", F.col("pkt_no").alias("pos"), "path", "importance"
    )


@query("edge_threshold", sql("""
    SELECT trace_id, round(quantile_cont(importance, 0.9), 6) AS threshold
    FROM e GROUP BY trace_id""", e=_IMPORTANCE))
def edge_threshold(spark, folder):
    return rounded(ex.edge_threshold(_importances(spark, folder)))


@query("abnormal_edges", sql("""
    SELECT trace_id, pos, path, round(importance, 6) AS importance
    FROM e JOIN (SELECT trace_id, quantile_cont(importance, 0.9) AS cut FROM e GROUP BY 1)
    USING (trace_id) WHERE importance >= cut AND importance > 0""", e=_IMPORTANCE))
def abnormal_edges(spark, folder):
    out = ex.abnormal_edges(_importances(spark, folder))
    return rounded(out.select("trace_id", "pos", "path", "importance"))


@query("top_weights", sql("""
    SELECT trace_id, feature, round(weight, 6) AS weight, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY abs(weight) DESC, feature)
               AS rank
        FROM (SELECT user_id::VARCHAR AS trace_id, event_type AS feature, avg(value) - 50 AS weight
              FROM events GROUP BY 1, 2)) WHERE rank <= 5"""))
def top_weights(spark, folder):
    """Mean values per user and event type stand for feature weights."""
    weights = t.table(spark, folder, "events").groupBy(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("feature")
    ).agg((F.avg("value") - 50).alias("weight"))
    return rounded(ex.top_weights(weights))


@query("explain_forest")
def explain_forest(spark, folder):
    rows = features(spark, folder).withColumnRenamed("_id", "trace_id")
    return ex.explain_forest(rows, models(spark, folder).forest)


@query("explain_graph")
def explain_graph(spark, folder):
    rows = graph_rows(spark, folder).withColumnRenamed("_id", "trace_id")
    return ex.explain_graph(rows, models(spark, folder).gcn)


def _edges_sql(weights):
    """Fall of the probability of a one-layer net, edge by edge."""
    (w, b), head = weights.layers[0], weights.head
    return sql("""
        SELECT e.trace_id, e.pos, e.from_id, e.to_id, round(CASE WHEN e.from_id = e.to_id THEN 0.0 ELSE greatest(0.0,
            1.0 / (1.0 + exp(-g.z)) - 1.0 / (1.0 + exp(-(g.z + l.shift / g.nodes)))) END, 6) AS importance
        FROM edges e JOIN whole g USING (trace_id)
        LEFT JOIN cut l ON l.trace_id = e.trace_id AND l.from_id = e.from_id AND l.to_id = e.to_id""",
        links=_LINKS, scaled=_SCALED,
        a0="""
            SELECT trace_id, node_id, sum(v) AS a FROM (
                SELECT trace_id, node_id, x / d AS v FROM scaled
                UNION ALL
                SELECT t.trace_id, t.node_id, l.n * s.x / sqrt(s.d * t.d)
                FROM links l
                JOIN scaled s ON s.trace_id = l.trace_id AND s.node_id = l.from_id
                JOIN scaled t ON t.trace_id = l.trace_id AND t.node_id = l.to_id)
            GROUP BY 1, 2""",
        w0=f"""SELECT o, {_matrix(w[0])}[o] AS w, {_matrix(b)}[o] AS b, {_matrix(head[0])}[o] AS h
               FROM range(1, {w.shape[1] + 1}) AS y(o)""",
        whole=f"""SELECT trace_id, count(DISTINCT node_id) AS nodes, {head[1]!r}::DOUBLE
                   + sum(h * greatest(0.0, a * w + b)) / count(DISTINCT node_id) AS z
                  FROM a0 CROSS JOIN w0 GROUP BY 1""",
        cut="""SELECT l.trace_id, l.from_id, l.to_id, sum(h * (
                   greatest(0.0, (a.a - s.x / sqrt(s.d * t.d)) * w + b) - greatest(0.0, a.a * w + b))) AS shift
               FROM links l
               JOIN scaled s ON s.trace_id = l.trace_id AND s.node_id = l.from_id
               JOIN scaled t ON t.trace_id = l.trace_id AND t.node_id = l.to_id
               JOIN a0 a ON a.trace_id = l.trace_id AND a.node_id = l.to_id CROSS JOIN w0
               GROUP BY 1, 2, 3""")


@query("explain_edges", _edges_sql(initial_weights(64, 1)))
def explain_edges(spark, folder):
    """Importance of every edge for the one-layer net, graphs in tasks."""
    edges = checkpointed(g.call_edges(t.requests(spark, folder)))
    return rounded(ex.explain_edges(edges, initial_weights(64, 1)))


@query("explain_edges_large_graphs", _edges_sql(initial_weights(64, 1)))
def explain_edges_large_graphs(spark, folder):
    """The form for graphs that fit no task, here for all graphs."""
    edges = checkpointed(g.call_edges(t.requests(spark, folder)))
    return rounded(ex.explain_edges(edges, initial_weights(64, 1), task_edges=0))


def _stored(spark, folder):
    """Stored records of all sessions; sessions of address 8.8.* kept no features."""
    rows = j.pair_by_id(features(spark, folder), graph_rows(spark, folder))
    kept = ~F.col("source_ip").startswith("8.8.")
    return rows.select(
        F.col("_id").alias("trace_id"),
        F.when(kept, records.features_to_json(MODEL_INPUT)).alias("features_json"),
        records.graph_to_json(F.col("call_graph")).alias("call_graph_json"),
    )


@query("explain_batch")
def explain_batch(spark, folder):
    m = models(spark, folder)
    stored = _stored(spark, folder)
    out = ex.explain_batch(stored.select("trace_id"), stored, m.forest, m.gcn, m.fallback)
    return out.select(
        "trace_id", "status", F.to_json("lime_weights").alias("lime_weights"),
        F.to_json("abnormal_edges").alias("abnormal_edges"),
    )


# --- Detection jobs ------------------------------------------------------------------


@query("detect_batch")
def detect_batch(spark, folder):
    rows = features(spark, folder).withColumn("copies", F.lit(1))
    scored, _ = detect.detect_batch(rows, graph_rows(spark, folder), models(spark, folder), 7)
    return scored.drop("features_json", "call_graph_json")


@query("detect_batch_skipped", sql("""
    SELECT _id AS id, CASE WHEN "vsession_duration(min)" > 8000
        THEN 'feature vsession_duration(min) is NULL' ELSE 'category source is not valid' END
        AS reason
    FROM features JOIN (SELECT DISTINCT trace_id AS _id FROM edges) USING (_id)
    WHERE "vsession_duration(min)" > 8000 OR sequence_length_ > 15""".replace(
        "sequence_length_", '"sequence_length(count)"')))
def detect_batch_skipped(spark, folder):
    """Long sessions lose a number and sessions with many requests a category."""
    minutes = c("vsession_duration(min)")
    many = c("sequence_length(count)") > 15
    rows = features(spark, folder).withColumns({
        "source": F.when(~many, F.col("source")),
        "vsession_duration(min)": F.when(minutes <= 8000, minutes),
        "copies": F.lit(1),
    })
    _, skipped = detect.detect_batch(rows, graph_rows(spark, folder), models(spark, folder), 7)
    return skipped


@query("detect_graph_only")
def detect_graph_only(spark, folder):
    scored, _ = detect.detect_batch(
        None, graph_rows(spark, folder), models(spark, folder), 8, allow_graph_only=True)
    return scored.drop("features_json", "call_graph_json")


def _literal_forest(df):
    """Stands in for a fitted forest: long sessions are suspicious."""
    long = F.least(F.lit(1.0), c("sequence_length(count)") / F.lit(24.0))
    return df.withColumn("rf_prob", F.when(F.col("has_features"), long).otherwise(F.lit(0.0)))


_NETS = (initial_weights(64, 2), initial_weights(64, 1))
_LITERAL = detect.Models(_literal_forest, *_NETS)


@query("detect_records", sql("""
    SELECT trace_id, source_ip, round(rf, 6) AS rf_prob, round(gcn, 6) AS gcn_prob,
           round(CASE WHEN event_type = 'view' THEN gcn WHEN event_type = 'click' THEN rf
                ELSE prob END, 6) AS final_prob,
           CASE WHEN event_type = 'view' THEN hard_gcn WHEN event_type = 'click' THEN hard_rf
                ELSE (prob > threshold)::INTEGER END AS is_anomaly,
           CASE WHEN event_type = 'view' THEN 'gcn_only' WHEN event_type = 'click' THEN 'rf_only'
                ELSE mode END AS mode,
           round(CASE WHEN event_type IN ('view', 'click') THEN 0.5 ELSE threshold END, 6) AS threshold
    FROM my_adaptive""",
    **_gcn_views(_NETS[0], "rich_prob", "r") | _gcn_views(_NETS[1], "poor_prob", "p"),
    my_scores="""
        SELECT *, CASE WHEN poor AND graph THEN 'view' WHEN NOT poor AND NOT graph THEN 'click'
                       WHEN poor THEN 'signup' ELSE 'error' END AS event_type FROM (
            SELECT f._id AS trace_id, f.source_ip, f.poor,
                   CASE WHEN f.poor THEN 0.0 ELSE least(1.0, f.n / 24.0) END::DOUBLE AS rf,
                   f.graph AND r.trace_id IS NOT NULL AS graph,
                   CASE WHEN NOT f.graph OR r.trace_id IS NULL THEN 0.0
                        WHEN f.poor THEN p.gcn_prob ELSE r.gcn_prob END::DOUBLE AS gcn
            FROM (SELECT _id, source_ip, "sequence_length(count)" AS n, source_ip LIKE '8.8.%' AS poor,
                         source_ip NOT LIKE '172.%' AS graph FROM features) f
            LEFT JOIN rich_prob r ON r.trace_id = f._id LEFT JOIN poor_prob p ON p.trace_id = f._id
            WHERE f.poor OR f.n <= 15)""",
    my_judged=VIEWS["judged"].replace("scores", "my_scores"),
    my_adaptive=VIEWS["adaptive"].replace("judged", "my_judged")))
def detect_records(spark, folder):
    """Sessions of 8.8.* have no features, those of 172.* no graph, and long ones a category that
    does not validate."""
    rows = features(spark, folder).withColumnRenamed("_id", "trace_id")
    poor, many = F.col("source_ip").startswith("8.8."), c("sequence_length(count)") > 15
    absent = {n: F.when(~poor, c(n)) for n in MODEL_INPUT}
    absent["source"] = F.when(~poor & ~many, F.col("source"))
    edges = g.call_edges(t.requests(spark, folder)).join(
        rows.where(~F.col("source_ip").startswith("172.")).select("trace_id"), "trace_id", "left_semi")
    scored, _ = detect.detect_records(rows.withColumns(absent), _LITERAL, edges)
    return rounded(scored.drop("features_json", "call_graph_json"))


@query("capture_task", sql("""
    SELECT 9::BIGINT AS task_id, 'COMPLETED' AS status, 2500::BIGINT AS duration,
           (SELECT count(DISTINCT trace_id) FROM raw_http) AS record_count,
           (SELECT count(*) FROM pages WHERE page_id % 50 = 0) AS skipped_count,
           (SELECT count(*) - count(DISTINCT trace_id) FROM http_requests)::BIGINT AS edges"""))
def capture_task(spark, folder):
    """Counts of a capture task over the pages, and the edges in the graph texts of its records;
    every fiftieth page stands for a file that cannot be read."""
    broken = t.table(spark, folder, "pages").where("page_id % 50 = 0").select(
        F.concat(F.lit("p"), "page_id").alias("trace_id"), F.concat("page_id", F.lit(".pcap")).alias("file_name"),
        F.lit("not a capture file").alias("error"))
    decoded = _page_packets(spark, folder).unionByName(broken, allowMissingColumns=True)
    task = spark.sql("""SELECT 9L AS task_id, TIMESTAMP '2024-01-01 00:00:00' AS start_time,
                        TIMESTAMP '2024-01-01 00:00:02.5' AS end_time""")
    scored, summary, _ = detect.detect_capture_task(decoded, _LITERAL, task)
    edges = scored.agg(F.sum(F.json_array_length("call_graph_json")).cast("long").alias("edges"))
    return summary.select("task_id", "status", "duration", "record_count", "skipped_count").crossJoin(edges)


def _page_packets(spark, folder):
    """Pages as packets with HTTP payload; a host name is one capture."""
    return t.raw_http(spark, folder).select(
        "trace_id", F.lit(None).cast("string").alias("file_name"), "pkt_no", "ts",
        F.lit("10.0.0.9").alias("src_ip"), F.lit("10.0.0.1").alias("dst_ip"),
        F.lit(5000).alias("src_port"), F.lit(80).alias("dst_port"), "payload",
    )


@query("detect_captures")
def detect_captures(spark, folder):
    packets = _page_packets(spark, folder)
    return detect.detect_captures(packets, models(spark, folder), 9).drop("features_json", "call_graph_json")


@query("compare_methods")
def compare_methods(spark, folder):
    rows = checkpointed(labelled_sessions(spark, folder).join(graph_rows(spark, folder), "_id"))
    parts = _split(spark, folder, rows)
    metrics, _ = compare.compare_methods(*parts)
    return metrics


@query("gate_stability")
def gate_stability(spark, folder):
    """Five seeded gates on the scores of the events, each judged on the test split."""
    parts = pr.parts_of(pr.stratified_split(t.scores(spark, folder), [0.6, 0.2, 0.2], "trace_id", "y"), 3)
    metrics, spread, _, _ = compare.gate_stability(*parts)
    return metrics.withColumn("f1_mean", spread.select("f1_mean").scalar())


@query("train_report")
def train_report(spark, folder):
    """The training job on the sessions: metrics of the three models."""
    return train.train_models(labelled_sessions(spark, folder).drop("y"), graph_rows(spark, folder))[1]


@query("sweep_epochs")
def sweep_epochs(spark, folder):
    """All methods after every candidate epoch count."""
    rows = checkpointed(labelled_sessions(spark, folder).join(graph_rows(spark, folder), "_id"))
    return compare.sweep_epochs(*_split(spark, folder, rows), gcn.EPOCH_CANDIDATES)
