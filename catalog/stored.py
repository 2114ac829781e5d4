"""Queries on stored verdicts, tasks, live counts and explanation requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowverdict.operators import joins as j, results as r
from flowverdict.sources import tables as t

from .registry import query, rounded
from .views import sql

_COLS = ["id", "trace_id", "source_ip", "timestamp", "final_prob", "is_anomaly", "detect_type",
         "file_id", "task_name"]
_SQL_COLS = ", ".join("round(final_prob, 6) AS final_prob" if n == "final_prob" else n
                      for n in _COLS)
# 2024-01-20 12:00:00 UTC
NOW_MS = 1705752000000


def _rows(df):
    return rounded(df.select(*_COLS))


@query("filter_results", sql(f"""
    SELECT {_SQL_COLS} FROM results
    WHERE lower(trace_id) LIKE '%evt-1%' AND lower(source_ip) LIKE '%.1%' AND is_anomaly = 1
      AND detect_type = 1 AND final_prob >= 0.2 AND final_prob <= 0.9
      AND timestamp >= 1704326400000 AND timestamp <= 1706313600000 AND file_id = 3
      AND lower(task_name) LIKE '%task%'"""))
def filter_results(spark, folder):
    return _rows(r.filter_results(
        t.results(spark, folder), trace_id="EVT-1", source_ip=".1", is_anomaly=1, detect_type=1,
        min_prob=0.2, max_prob=0.9, start_time=1704326400000, end_time=1706313600000, file_id=3,
        task_name="tASK",
    ))


@query("results_page", sql(f"""
    SELECT {_SQL_COLS} FROM results WHERE is_anomaly = 1
    ORDER BY timestamp DESC, id LIMIT 10 OFFSET 20"""))
def results_page(spark, folder):
    return _rows(r.results_page(t.results(spark, folder), current=3, size=10, is_anomaly=1))


@query("deep_results_page", sql(f"""
    SELECT {_SQL_COLS} FROM results ORDER BY timestamp DESC, id LIMIT 10 OFFSET 900"""))
def deep_results_page(spark, folder):
    """The page form for depths where a top-k would not fit one task."""
    return _rows(r.page(t.results(spark, folder), "timestamp", "id", 91, 10, deep=100))


@query("page_total", sql("SELECT count(*) AS total FROM results WHERE is_anomaly = 1"))
def page_total(spark, folder):
    return r.page_total(r.filter_results(t.results(spark, folder), is_anomaly=1))


@query("latest_records", sql(f"""
    SELECT {_SQL_COLS} FROM results ORDER BY timestamp DESC, id LIMIT 100"""))
def latest_records(spark, folder):
    return _rows(r.latest_records(t.results(spark, folder)))


@query("time_range", sql(f"""
    SELECT {_SQL_COLS} FROM results WHERE timestamp >= {NOW_MS} - 604800000"""))
def time_range(spark, folder):
    return _rows(r.time_range(t.results(spark, folder), "1w", now=NOW_MS))


@query("detection_statistics", sql("""
    SELECT count(*) FILTER (is_anomaly = 0) AS normal, count(*) FILTER (is_anomaly = 1) AS anomaly,
           count(*) AS total
    FROM results WHERE timestamp >= 1704326400000 AND timestamp <= 1706313600000"""))
def detection_statistics(spark, folder):
    return r.detection_statistics(t.results(spark, folder), 1704326400000, 1706313600000)


@query("filter_tasks", sql("""
    SELECT id, task_name, status FROM tasks
    WHERE lower(task_name) LIKE '%high%' AND status = 'F'
      AND create_time >= TIMESTAMP '1996-03-01 00:00:00'
      AND create_time <= TIMESTAMP '1998-03-31 23:59:59'"""))
def filter_tasks(spark, folder):
    out = r.filter_tasks(t.tasks(spark, folder), "HIGH", "F", "1996-03-01", "1998-03-31")
    return out.select("id", "task_name", "status")


@query("tasks_page", sql("""
    SELECT id, task_name, status FROM tasks WHERE status = 'O'
    ORDER BY create_time DESC, id LIMIT 10 OFFSET 10"""))
def tasks_page(spark, folder):
    out = r.tasks_page(t.tasks(spark, folder), current=2, status="O")
    return out.select("id", "task_name", "status")


@query("latest_by_trace", sql(f"""
    SELECT session, {_SQL_COLS} FROM (
        SELECT *, row_number() OVER (PARTITION BY session ORDER BY id DESC) AS k FROM results)
    WHERE k = 1"""))
def latest_by_trace(spark, folder):
    """The newest verdict of each session."""
    rows = t.results(spark, folder).select("session", *_COLS).withColumnsRenamed(
        {"trace_id": "event", "session": "trace_id"}
    ).withColumn("arrival", F.col("id"))
    out = r.latest_by_trace(rows).withColumnsRenamed({"trace_id": "session"})
    return _with_session(out.withColumnRenamed("event", "trace_id"))


def _with_session(df):
    return rounded(df.select("session", *_COLS))


@query("upsert_by_trace", sql("""
    SELECT session AS trace_id,
           coalesce(min(id) FILTER (event_type <> 'error'), min(id)) AS id,
           round(coalesce(arg_max(final_prob, id) FILTER (event_type = 'error'),
                          arg_max(final_prob, id)), 6) AS final_prob
    FROM results GROUP BY session"""))
def upsert_by_trace(spark, folder):
    """Verdicts on errors arrive after all others."""
    rows = t.results(spark, folder).select(
        F.col("session").alias("trace_id"), "id", "final_prob", F.col("id").alias("arrival"),
        (F.col("task_name") == "Task error").alias("late"),
    )
    old, new = rows.where(~F.col("late")).drop("late"), rows.where("late").drop("late")
    return rounded(r.upsert_by_trace(old, new).drop("arrival"))


@query("tag_with_task", sql("""
    SELECT r.id, r.file_id, 1 AS detect_type, t.task_name
    FROM (SELECT id, file_id FROM results WHERE file_id IS NOT NULL) r
    JOIN tasks t ON t.id = r.file_id"""))
def tag_with_task(spark, folder):
    rows = t.results(spark, folder).select("id", F.col("file_id").alias("task_id"))
    out = r.tag_with_task(rows.where(F.col("task_id").isNotNull()), t.tasks(spark, folder))
    return out.select("id", "file_id", "detect_type", "task_name")


@query("sequence_timestamps", sql(f"""
    SELECT id, task_name, {NOW_MS} + row_number() OVER (PARTITION BY task_name ORDER BY id) - 1
           AS timestamp FROM results"""))
def sequence_timestamps(spark, folder):
    rows = t.results(spark, folder).select("id", "task_name")
    return r.sequence_timestamps(rows, NOW_MS, ["id"], task_key="task_name")


@query("per_second_rates", sql("""
    SELECT epoch_ms(date_trunc('second', event_time)) AS second, count(*) AS qps,
           count(*) FILTER (is_anomaly = 1) AS anomalies FROM results GROUP BY 1"""))
def per_second_rates(spark, folder):
    out = r.per_second_rates(t.results(spark, folder))
    return out.withColumn("second", F.unix_millis("second"))


@query("rate_series", sql(f"""
    SELECT {NOW_MS} - 1000 * s AS second, count(id) AS qps,
           count(id) FILTER (is_anomaly = 1) AS anomalies
    FROM range(1, 3601) AS axis(s)
    LEFT JOIN results ON timestamp // 1000 = {NOW_MS // 1000} - s GROUP BY 1"""))
def rate_series(spark, folder):
    """One hour instead of one minute, so that some seconds hold events."""
    rates = r.per_second_rates(t.results(spark, folder))
    out = r.rate_series(rates, "2024-01-20 12:00:00", 3600)
    return out.withColumn("second", F.unix_millis("second"))


@query("live_counters", sql("""
    SELECT count(*) AS total, count(*) FILTER (is_anomaly = 1) AS anomaly
    FROM results WHERE timestamp >= 1704326400000"""))
def live_counters(spark, folder):
    return r.live_counters(t.results(spark, folder), now=NOW_MS, start=1704326400000, end=NOW_MS)


@query("latest_score", sql("""
    SELECT round(final_prob, 6) AS final_prob FROM results
    ORDER BY timestamp DESC, id DESC LIMIT 1"""))
def latest_score(spark, folder):
    return rounded(r.latest_score(t.results(spark, folder)))


def explain_events(spark, folder):
    """Events as steps of explanation requests of their session."""
    kind = F.col("event_type")
    return t.packets(spark, folder).select(
        "trace_id", F.col("pkt_no").alias("ord"),
        F.when(kind.isin("click", "view"), "request").when(kind == "error", "error")
        .otherwise("result").alias("kind"),
        F.when(kind.isin("purchase", "signup"), F.col("path")).alias("payload"),
    )


@query("explain_lifecycle", sql("""
    SELECT trace_id,
           CASE arg_max(kind, ord) WHEN 'request' THEN 0 WHEN 'result' THEN 1 ELSE 2 END AS status,
           arg_max(payload, ord) FILTER (kind = 'result') AS payload,
           count(*) FILTER (kind = 'request' AND before IS DISTINCT FROM 'request') AS jobs
    FROM (SELECT *, lag(kind) OVER (PARTITION BY trace_id ORDER BY ord) AS before
          FROM steps WHERE ord >= first)
    GROUP BY trace_id""",
    raw="""SELECT trace_id, pkt_no AS ord,
             CASE WHEN event_type IN ('click', 'view') THEN 'request'
                  WHEN event_type = 'error' THEN 'error' ELSE 'result' END AS kind,
             CASE WHEN event_type IN ('purchase', 'signup') THEN path END AS payload
             FROM packets""",
    steps="""SELECT *, min(ord) FILTER (kind = 'request') OVER (PARTITION BY trace_id) AS first
             FROM raw"""))
def explain_lifecycle(spark, folder):
    return r.explain_lifecycle(explain_events(spark, folder))


@query("explain_requests", sql("""
    SELECT r.session AS trace_id, count(*) AS found FROM (
        SELECT DISTINCT session FROM results WHERE is_anomaly = 1) r
    JOIN packets p ON p.trace_id = r.session GROUP BY 1"""))
def explain_requests(spark, folder):
    """Sessions with an anomaly ask for an explanation; here the lookup is counted."""
    rows = t.results(spark, folder)
    wanted = rows.where(F.col("is_anomaly") == 1).select(F.col("session").alias("trace_id"))
    stored = rows.select(
        F.col("session").alias("trace_id"), F.lit("{}").alias("features_json"),
        F.lit("[]").alias("call_graph_json"),
    )
    found = j.explain_requests(wanted, stored)
    return found.groupBy("trace_id").agg(F.count("features_json").alias("found"))


@query("missing_requests", sql("""
    SELECT DISTINCT session AS trace_id FROM results
    EXCEPT SELECT session FROM results WHERE is_anomaly = 1"""))
def missing_requests(spark, folder):
    """Every session asks, but only those with an anomaly are stored."""
    rows = t.results(spark, folder).withColumn("trace_id", F.col("session"))
    return j.missing_requests(rows, rows.where(F.col("is_anomaly") == 1))
