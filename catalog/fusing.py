"""Queries on score fusion, evaluation and parameter searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowverdict.functions import fusion as fu
from flowverdict.operators import grids, joins as j, metrics as m
from flowverdict.sources import tables as t

from .registry import query, rounded
from .views import sql


def rf():
    return F.col("rf_prob")


def gcn():
    return F.col("gcn_prob")


def _fused(spark, folder, fusion, *columns):
    out = t.scores(spark, folder).withColumn("f", fusion)
    return rounded(out.select("trace_id", *[F.col(f"f.{n}").alias(n) for n in columns]))


@query("confidence", sql("""
    SELECT trace_id, round(conf_rf, 6) AS conf_rf, hard_rf, round(conf_gcn, 6) AS conf_gcn,
           hard_gcn FROM judged"""))
def confidence(spark, folder):
    return rounded(t.scores(spark, folder).select(
        "trace_id", fu.confidence(rf()).alias("conf_rf"), fu.hard(rf()).alias("hard_rf"),
        fu.confidence(gcn()).alias("conf_gcn"), fu.hard(gcn()).alias("hard_gcn"),
    ))


@query("fuse_adaptive", sql("""
    SELECT trace_id, round(prob, 6) AS prob, round(threshold, 6) AS threshold,
           (prob > threshold)::INTEGER AS verdict, mode, round(w, 6) AS weight_rf
    FROM adaptive"""))
def fuse_adaptive(spark, folder):
    return _fused(spark, folder, fu.fuse_adaptive(rf(), gcn()),
                  "prob", "threshold", "verdict", "mode", "weight_rf")


@query("fuse_fixed", sql("""
    SELECT trace_id, round(p, 6) AS prob, (p > 0.5::DOUBLE)::INTEGER AS verdict, 'fixed' AS mode
    FROM (SELECT trace_id, 0.33::DOUBLE * rf + (1.0::DOUBLE - 0.33::DOUBLE) * gcn AS p
          FROM scores)"""))
def fuse_fixed(spark, folder):
    return _fused(spark, folder, fu.fuse_fixed(rf(), gcn()), "prob", "verdict", "mode")


def _strategy_weight(alpha, conf, high, low):
    """SQL of the confidence-chosen weight; arguments are SQL expressions."""
    return f"""CASE WHEN hard_rf = hard_gcn THEN {alpha}
        WHEN conf_rf > {conf} AND conf_gcn <= {conf} THEN {high}
        WHEN conf_gcn > {conf} AND conf_rf <= {conf} THEN {low}
        WHEN conf_rf > {conf} AND conf_gcn > {conf} AND conf_rf > conf_gcn THEN {high}
        WHEN conf_rf > {conf} AND conf_gcn > {conf} THEN {low}
        ELSE {alpha} END"""


def _strategy_threshold(rf, gcn):
    return f"""greatest(0.1::DOUBLE, least(0.9::DOUBLE,
        CASE WHEN hard_rf = hard_gcn THEN 0.5::DOUBLE
             WHEN hard_rf = 1 THEN 0.5::DOUBLE + {rf} ELSE 0.5::DOUBLE - {gcn} END))"""


def _lit(x):
    return f"{x!r}::DOUBLE"


_W = _strategy_weight(_lit(0.2), _lit(0.4), _lit(0.45), _lit(0.1))
_WD = _strategy_weight(_lit(0.2), _lit(0.4), _lit(0.5), _lit(0.1))
_T = _strategy_threshold(_lit(0.05), _lit(0.03))


def _strategy_sql(weight, threshold):
    return sql(f"""
        SELECT trace_id, round(p, 6) AS prob, round(th, 6) AS threshold,
               (p > th)::INTEGER AS verdict
        FROM (SELECT trace_id, w * rf + (1.0::DOUBLE - w) * gcn AS p, th
              FROM (SELECT *, {weight} AS w, {threshold} AS th FROM judged))""")


@query("fuse_confidence_weight", _strategy_sql(_W, "0.5::DOUBLE"))
def fuse_confidence_weight(spark, folder):
    return _fused(spark, folder, fu.fuse_confidence_weight(rf(), gcn(), **fu.BEST_CONFIDENCE),
                  "prob", "threshold", "verdict")


@query("fuse_adaptive_threshold", _strategy_sql("0.32::DOUBLE", _T))
def fuse_adaptive_threshold(spark, folder):
    return _fused(spark, folder, fu.fuse_adaptive_threshold(rf(), gcn(), **fu.BEST_THRESHOLD),
                  "prob", "threshold", "verdict")


@query("fuse_dual", _strategy_sql(_WD, _T))
def fuse_dual(spark, folder):
    return _fused(spark, folder, fu.fuse_dual(rf(), gcn(), **fu.BEST_DUAL),
                  "prob", "threshold", "verdict")


@query("fuse_with_fallback", sql("""
    SELECT trace_id,
           round(CASE WHEN event_type = 'view' THEN gcn WHEN event_type = 'click' THEN rf
                ELSE prob END, 6) AS final_prob,
           CASE WHEN event_type = 'view' THEN hard_gcn WHEN event_type = 'click' THEN hard_rf
                ELSE (prob > threshold)::INTEGER END AS is_anomaly,
           CASE WHEN event_type = 'view' THEN 'gcn_only' WHEN event_type = 'click' THEN 'rf_only'
                ELSE mode END AS mode,
           round(CASE WHEN event_type IN ('view', 'click') THEN 0.5 ELSE threshold END, 6)
               AS threshold,
           round(CASE WHEN event_type = 'view' THEN 0.0 WHEN event_type = 'click' THEN 1.0
                ELSE w END, 6) AS weight_rf
    FROM adaptive"""))
def fuse_with_fallback(spark, folder):
    """Views have a graph only, clicks features only, signups neither, the rest both."""
    kind = F.col("event_type")
    rows = t.scores(spark, folder).select(
        "trace_id", "rf_prob", "gcn_prob",
        (~kind.isin("view", "signup")).alias("has_features"),
        (~kind.isin("click", "signup")).alias("has_graph"),
    )
    out = fu.fuse_with_fallback(rows)
    return rounded(out.drop("rf_prob", "gcn_prob", "has_features", "has_graph"))


@query("gate_inputs", sql("""
    SELECT trace_id, round(rf, 6) AS i0, round(gcn, 6) AS i1, round(conf_rf, 6) AS i2,
           round(conf_gcn, 6) AS i3, round(rf * gcn, 6) AS i4, round(abs(rf - gcn), 6) AS i5
    FROM judged"""))
def gate_inputs(spark, folder):
    out = t.scores(spark, folder).withColumn("g", fu.gate_inputs(rf(), gcn()))
    return rounded(out.select("trace_id", *[F.get("g", F.lit(i)).alias(f"i{i}")
                                            for i in range(6)]))


@query("align_scores", sql("""
    SELECT a.trace_id, round(a.rf, 6) AS rf_prob, round(b.gcn, 6) AS gcn_prob
    FROM scores a JOIN scores b USING (trace_id) WHERE b.event_type <> 'signup'"""))
def align_scores(spark, folder):
    """Signups have no graph score."""
    rows = t.scores(spark, folder)
    graphs = rows.where(F.col("event_type") != "signup").select("trace_id", "gcn_prob")
    return rounded(j.align_scores(rows.select("trace_id", "rf_prob"), graphs))


# --- Evaluation ----------------------------------------------------------------------

_RATIOS = """
    round(CASE WHEN tn+fp+fn+tp > 0 THEN (tp+tn)/(tn+fp+fn+tp)::DOUBLE ELSE 0 END, 6) AS accuracy,
    round(CASE WHEN tp+fp > 0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp+fn > 0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END, 6) AS f1,
    round(CASE WHEN fp+tn > 0 THEN fp/(fp+tn)::DOUBLE ELSE 0 END, 6) AS fpr,
    round(CASE WHEN fn+tp > 0 THEN fn/(fn+tp)::DOUBLE ELSE 0 END, 6) AS fnr,
    tn+fp AS normal_count, fn+tp AS anomaly_count"""


def _counts(verdict):
    return f"""count(*) FILTER (y = 0 AND {verdict} = 0) AS tn,
        count(*) FILTER (y = 0 AND {verdict} = 1) AS fp,
        count(*) FILTER (y = 1 AND {verdict} = 0) AS fn,
        count(*) FILTER (y = 1 AND {verdict} = 1) AS tp"""


@query("classification_metrics", sql(f"""
    SELECT event_type, tn, fp, fn, tp, {_RATIOS}
    FROM (SELECT event_type, {_counts('(prob > threshold)::INTEGER')} FROM adaptive
          GROUP BY event_type)"""))
def classification_metrics(spark, folder):
    """Per event type: only errors are positives, so every ratio also meets a zero."""
    rows = fu.fuse(t.scores(spark, folder)).withColumn("predicted", F.col("fusion.verdict"))
    return rounded(m.classification_metrics(rows, ["event_type"]))


@query("truth_metrics", sql(f"""
    SELECT tn, fp, fn, tp, {_RATIOS}
    FROM (SELECT {_counts('toxic')} FROM (SELECT quality AS y, toxic FROM labels))"""))
def truth_metrics(spark, folder):
    rows = t.table(spark, folder, "labels")
    return rounded(m.classification_metrics(rows, y="quality", predicted="toxic"))


@query("class_distribution", sql("""
    SELECT event_type, y, count(*) AS rows FROM scores GROUP BY 1, 2"""))
def class_distribution(spark, folder):
    return m.class_distribution(t.scores(spark, folder), ["event_type", "y"])


@query("score_distribution", sql("""
    SELECT event_type, round(avg(rf), 6) AS rf_prob_mean, round(stddev_pop(rf), 6) AS rf_prob_std,
           round(avg(gcn), 6) AS gcn_prob_mean, round(stddev_pop(gcn), 6) AS gcn_prob_std
    FROM scores GROUP BY 1"""))
def score_distribution(spark, folder):
    return rounded(
        m.score_distribution(t.scores(spark, folder), ["event_type"], ["rf_prob", "gcn_prob"])
    )


_BY_RUN = """
    SELECT day, CASE WHEN 2*tp+fp+fn > 0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END AS f1
    FROM (SELECT strftime(event_time, '%Y%m%d') AS day, {} FROM (
              SELECT *, (event_type = 'error')::INTEGER AS y FROM results) GROUP BY 1)"""


@query("run_stability", sql("""
    SELECT 'adaptive' AS method, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std,
           round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max,
           (SELECT day FROM runs ORDER BY f1 DESC, day LIMIT 1) AS best_run,
           stddev_pop(f1) <= 0.05 AS stable
    FROM runs""", runs=_BY_RUN.format(_counts("is_anomaly"))))
def run_stability(spark, folder):
    """Each day's verdicts stand for one run."""
    rows = t.results(spark, folder).select(
        F.date_format("event_time", "yyyyMMdd").alias("day"), "is_anomaly",
        (F.col("task_name") == "Task error").cast("int").alias("y"),
    )
    runs = m.classification_metrics(rows, ["day"], predicted="is_anomaly").withColumn(
        "method", F.lit("adaptive")
    )
    return rounded(m.run_stability(runs, ["method"], "day"))


_TIMINGS = """SELECT CASE event_type WHEN 'view' THEN 'rf' WHEN 'click' THEN 'gcn'
    WHEN 'error' THEN 'fusion' ELSE 'total' END AS stage, value AS ms FROM events"""


def _timings(spark, folder):
    """Event values as milliseconds of four stages."""
    kind = F.col("event_type")
    stage = (
        F.when(kind == "view", "rf").when(kind == "click", "gcn").when(kind == "error", "fusion")
        .otherwise("total")
    )
    return t.table(spark, folder, "events").select(stage.alias("stage"),
                                                   F.col("value").alias("ms"))


@query("stage_latency", sql("""
    SELECT stage, round(sum(ms), 4) AS total, round(avg(ms), 6) AS avg, min(ms) AS min,
           max(ms) AS max, count(ms) AS count FROM timings GROUP BY stage""", timings=_TIMINGS))
def stage_latency(spark, folder):
    out = m.stage_latency(_timings(spark, folder))
    return rounded(out.withColumn("total", F.round("total", 4)))


@query("latency_summary", sql("""
    SELECT round(rf, 4) AS rf_total_ms, round(rf_a, 6) AS rf_avg_ms,
           round(gcn, 4) AS gcn_total_ms, round(gcn_a, 6) AS gcn_avg_ms,
           round(fu, 4) AS fusion_total_ms, round(fu_a, 6) AS fusion_avg_ms,
           round(tot, 4) AS total_total_ms, round(tot_a, 6) AS total_avg_ms, n AS sample_count,
           round(rf + gcn, 4) AS model_output_total_ms,
           round((rf + gcn) / n, 6) AS model_output_avg_ms
    FROM (SELECT sum(ms) FILTER (stage = 'rf') AS rf, avg(ms) FILTER (stage = 'rf') AS rf_a,
                 sum(ms) FILTER (stage = 'gcn') AS gcn, avg(ms) FILTER (stage = 'gcn') AS gcn_a,
                 sum(ms) FILTER (stage = 'fusion') AS fu,
                 avg(ms) FILTER (stage = 'fusion') AS fu_a,
                 sum(ms) FILTER (stage = 'total') AS tot,
                 avg(ms) FILTER (stage = 'total') AS tot_a,
                 count(*) FILTER (stage = 'total') AS n FROM timings)""", timings=_TIMINGS))
def latency_summary(spark, folder):
    out = m.latency_summary(_timings(spark, folder))
    totals = {n: F.round(n, 4) for n in out.columns if n.endswith("total_ms")}
    return rounded(out.withColumns(totals))


_METHODS = """
    SELECT 'rf' AS method, 'single' AS category, y, hard_rf AS v FROM judged
    UNION ALL SELECT 'gcn', 'single', y, hard_gcn FROM judged
    UNION ALL SELECT 'fixed', 'fusion', y,
        (0.33::DOUBLE * rf + (1.0::DOUBLE - 0.33::DOUBLE) * gcn > 0.5)::INTEGER FROM judged
    UNION ALL SELECT 'adaptive', 'fusion', y, (prob > threshold)::INTEGER FROM adaptive"""


def _method_rows(spark, folder):
    rows = t.scores(spark, folder)
    verdicts = {
        "rf": fu.hard(rf()), "gcn": fu.hard(gcn()), "fixed": fu.fuse_fixed(rf(), gcn())["verdict"],
        "adaptive": fu.fuse_adaptive(rf(), gcn())["verdict"],
    }
    entries = F.array(*[
        F.struct(F.lit(n).alias("method"),
                 F.lit("single" if n in ("rf", "gcn") else "fusion").alias("category"),
                 v.alias("predicted"))
        for n, v in verdicts.items()
    ])
    return rows.select("y", F.inline(entries))


@query("best_per_category", sql("""
    SELECT category, method, round(f1, 6) AS f1,
           round((f1 - base) / base * 100.0, 6) AS gain_percent,
           method = (SELECT method FROM f ORDER BY f1 DESC, method LIMIT 1) AS overall_best
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, method) AS r,
                 (SELECT f1 FROM f WHERE method = 'rf') AS base FROM f) WHERE r = 1""",
    m=_METHODS,
    f="""SELECT method, category, 2.0::DOUBLE * count(*) FILTER (y = 1 AND v = 1)
         / (2 * count(*) FILTER (y = 1 AND v = 1) + count(*) FILTER (y <> v)) AS f1
         FROM m GROUP BY 1, 2"""))
def best_per_category(spark, folder):
    out = m.classification_metrics(_method_rows(spark, folder), ["method", "category"])
    return rounded(m.best_per_category(out, "rf"))


@query("concat_results", sql("""
    SELECT method, y, v AS predicted, count(*) AS rows FROM m GROUP BY 1, 2, 3""",
    m="SELECT * FROM (" + _METHODS + ") WHERE category = 'single'"))
def concat_results(spark, folder):
    rows = t.scores(spark, folder)
    parts = [
        rows.select(F.lit(n).alias("method"), "y", fu.hard(p).alias("predicted"))
        for n, p in (("rf", rf()), ("gcn", gcn()))
    ]
    return m.class_distribution(j.concat_results(parts), ["method", "y", "predicted"])


@query("split_overlap", sql("""
    SELECT *, train_test > 0 OR val_test > 0 AS leak FROM (SELECT
        (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
            INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS train_val,
        (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
            INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS train_test,
        (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
            INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS val_test)"""))
def split_overlap(spark, folder):
    """The customers of each order state stand for the ids of a split."""
    orders = t.table(spark, folder, "orders")
    parts = [orders.where(F.col("o_orderstatus") == x) for x in ("F", "O", "P")]
    return m.split_overlap(*parts, "o_custkey")


# --- Searches ------------------------------------------------------------------------


def _list(values):
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _unnest(name, values):
    return (f"(SELECT unnest({_list(values)}) AS {name}, "
            f"generate_subscripts({_list(values)}, 1) - 1 AS i_{name}) AS t_{name}")


def _search_sql(space, weight, threshold):
    names = list(space)
    grid = " CROSS JOIN ".join(_unnest(n, v) for n, v in space.items())
    cell = "0"
    for n, v in space.items():
        cell = f"({cell}) * {len(v)} + i_{n}"
    return sql(f"""
        SELECT cell, {', '.join(names)}, tn, fp, fn, tp, {_RATIOS} FROM (
            SELECT cell, {', '.join(names)}, {_counts('(p > th)::INTEGER')}
            FROM (SELECT *, w * rf + (1.0::DOUBLE - w) * gcn AS p FROM (
                SELECT g.*, y, rf, gcn, {weight} AS w, {threshold} AS th
                FROM judged CROSS JOIN grid g))
            GROUP BY cell, {', '.join(names)})""",
        grid=f"SELECT {cell} AS cell, {', '.join(names)} FROM {grid}")


_WG = _strategy_weight("alpha", "conf_threshold", "weight_high_conf", "weight_low_conf")
_TG = _strategy_threshold("threshold_adjust_rf", "threshold_adjust_gcn")


@query("search_fixed", sql(f"""
    SELECT gcn_layers, alpha, tn, fp, fn, tp, {_RATIOS} FROM (
        SELECT gcn_layers, alpha,
               {_counts('(alpha * rf + (1.0::DOUBLE - alpha) * g > 0.5::DOUBLE)::INTEGER')}
        FROM (SELECT *, (event_id * (7919 + 2 * gcn_layers) % 1009) / 1009.0::DOUBLE AS g
              FROM scores CROSS JOIN range(1, 6) AS layers(gcn_layers))
        CROSS JOIN (SELECT i / 100.0::DOUBLE AS alpha FROM range(0, 101) AS a(i))
        GROUP BY 1, 2)"""))
def search_fixed(spark, folder):
    """Five graph depths with a probability each, 101 weights: 505 cells."""
    event = F.col("trace_id").cast("long")
    depths = F.array(*[
        F.struct(
            F.lit(d).cast("long").alias("gcn_layers"),
            ((event * (7919 + 2 * d) % 1009) / F.lit(1009.0)).alias("gcn_prob"),
        )
        for d in range(1, 6)
    ])
    rows = t.scores(spark, folder).select("rf_prob", "y", F.inline(depths))
    return rounded(grids.search_fixed(rows))


@query("search_strategy1", _search_sql(grids.STRATEGY1, _WG, "0.5::DOUBLE"))
def search_strategy1(spark, folder):
    return rounded(grids.search_strategy1(t.scores(spark, folder)))


@query("search_strategy2", _search_sql(grids.STRATEGY2, "0.32::DOUBLE", _TG))
def search_strategy2(spark, folder):
    out = grids.search_strategy2(t.scores(spark, folder))
    return rounded(out.drop("alpha"))


_GRID1 = " CROSS JOIN ".join(_unnest(n, v) for n, v in grids.STRATEGY1.items())
_NAMES1 = ", ".join(grids.STRATEGY1)


def _side_sql(kind, threshold, extra, shifts):
    """Counts of the rows of one kind per (strategy 1 cell, shift)."""
    return f"""
        SELECT {_NAMES1}{extra}, {_counts('(w * rf + (1.0::DOUBLE - w) * gcn > th)::INTEGER')}
        FROM (SELECT *, {threshold} AS th FROM (
            SELECT {_NAMES1}, y, rf, gcn, hard_rf, hard_gcn, {_WG} AS w
            FROM judged CROSS JOIN {_GRID1} WHERE {kind}) {shifts})
        GROUP BY {_NAMES1}{extra}"""


@query("search_dual", sql(
    f"""SELECT row_number() OVER (ORDER BY {', '.join('i_' + n for n in grids.DUAL)}) - 1 AS cell,
               {', '.join(grids.DUAL)}, tn, fp, fn, tp, {_RATIOS}
        FROM (SELECT c.* EXCLUDE ({_NAMES1}), {', '.join(grids.DUAL)}, i_threshold_adjust_rf,
                     i_threshold_adjust_gcn, a.tn + r.tn + g.tn AS tn, a.fp + r.fp + g.fp AS fp,
                     a.fn + r.fn + g.fn AS fn, a.tp + r.tp + g.tp AS tp
              FROM (SELECT * FROM {_GRID1}) c
              CROSS JOIN {_unnest('threshold_adjust_rf', grids.RF_SHIFTS)}
              CROSS JOIN {_unnest('threshold_adjust_gcn', grids.GCN_SHIFTS)}
              JOIN agreed a USING ({_NAMES1})
              JOIN by_rf r USING ({_NAMES1}, threshold_adjust_rf)
              JOIN by_gcn g USING ({_NAMES1}, threshold_adjust_gcn))""",
    agreed=_side_sql("hard_rf = hard_gcn", "0.5::DOUBLE", "", ""),
    by_rf=_side_sql("hard_rf > hard_gcn",
                    "greatest(0.1::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE + threshold_adjust_rf))",
                    ", threshold_adjust_rf",
                    "CROSS JOIN " + _unnest("threshold_adjust_rf", grids.RF_SHIFTS)),
    by_gcn=_side_sql("hard_rf < hard_gcn",
                     "greatest(0.1::DOUBLE, least(0.9::DOUBLE, 0.5::DOUBLE - threshold_adjust_gcn))",
                     ", threshold_adjust_gcn",
                     "CROSS JOIN " + _unnest("threshold_adjust_gcn", grids.GCN_SHIFTS))))
def search_dual(spark, folder):
    """All 57,600 cells."""
    return rounded(grids.search_dual(t.scores(spark, folder)))


@query("cross_with_grid", sql(f"""
    SELECT cell, count(*) AS rows, round(avg(alpha * rf + (1.0::DOUBLE - alpha) * gcn), 6) AS fused
    FROM scores CROSS JOIN (SELECT unnest({_list(grids.ALPHAS)}) AS alpha,
                                   unnest(range(0, 8)) AS cell) GROUP BY cell"""))
def cross_with_grid(spark, folder):
    params = grids.parameter_grid(spark, {"alpha": grids.ALPHAS})
    rows = grids.cross_with_grid(t.scores(spark, folder), params)
    fused = fu.fuse_fixed(rf(), gcn(), F.col("alpha"))["prob"]
    return rounded(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"),
                                            F.avg(fused).alias("fused")))


def _cells(spark, folder):
    return grids.search_strategy2(t.scores(spark, folder)).select("cell", "f1", "fnr")


_S2 = _search_sql(grids.STRATEGY2, "0.32::DOUBLE", _TG)


@query("top_cells", f"SELECT cell, f1 FROM ({_S2}) ORDER BY f1 DESC, cell LIMIT 10")
def top_cells(spark, folder):
    return rounded(m.top_cells(rounded(_cells(spark, folder))).select("cell", "f1"))


@query("rank_desc", f"""
    SELECT cell, f1, row_number() OVER (ORDER BY f1 DESC, cell)::INTEGER AS rank FROM ({_S2})""")
def rank_desc(spark, folder):
    return m.rank_desc(rounded(_cells(spark, folder)).select("cell", "f1"), "f1", "cell")


@query("pick_best_f1", f"""
    SELECT cell, f1, fnr FROM ({_S2}) WHERE f1 > 0 ORDER BY f1 DESC, cell LIMIT 1""")
def pick_best_f1(spark, folder):
    return m.pick_best(rounded(_cells(spark, folder)))


@query("pick_best_fnr", f"""
    SELECT cell, f1, fnr FROM ({_S2}) ORDER BY fnr, f1 DESC, cell LIMIT 1""")
def pick_best_fnr(spark, folder):
    return m.pick_best(rounded(_cells(spark, folder)), rule="min_fnr")
