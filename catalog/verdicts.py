"""Queries on the verdict table that a stream has written, with compactions and a replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowverdict.operators import joins as j, results as r
from flowverdict.operators.lineage import shared_folder
from flowverdict.sources import tables as t
from flowverdict.sources.verdicts import VerdictStore
from flowverdict.streaming.detect import read_results, upsert_stream

from .registry import query, rounded
from .views import sql

_STORES: dict = {}
_PARTS = [("click", "view"), ("purchase", "signup"), ("error",)]
_COLUMNS = ["source_ip", "timestamp", "rf_prob", "gcn_prob", "final_prob", "is_anomaly",
            "detect_type", "file_id", "task_name"]

_VIEWS = {
    "arrived": f"""
        SELECT session AS trace_id, {', '.join(_COLUMNS)},
               CASE WHEN event_type IN ('click', 'view') THEN 0
                    WHEN event_type = 'error' THEN 2 ELSE 1 END AS batch FROM results""",
    "newest": """
        SELECT *, batch * 1099511627776 + row_number() OVER (PARTITION BY batch ORDER BY trace_id) AS given
        FROM (SELECT *, row_number() OVER (PARTITION BY batch, trace_id ORDER BY timestamp DESC,
                  source_ip DESC, rf_prob DESC, gcn_prob DESC, final_prob DESC) AS k FROM arrived)
        WHERE k = 1""",
    "stored": f"""
        SELECT trace_id, min(given)::BIGINT AS id, {', '.join(
            f'arg_max_null({n}, batch) AS {n}' for n in _COLUMNS)} FROM newest GROUP BY trace_id""",
}


def stored(spark, folder):
    """The verdicts of all events by session: three streamed batches, compacted after each of
    the first two, and a replay of the second. Written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORES:
        place = shared_folder(spark, "verdicts")
        store = VerdictStore(spark, f"{place}/out")
        rows = t.results(spark, folder).select(F.col("session").alias("trace_id"), *_COLUMNS)
        kinds = [rows.where(F.col("task_name").isin([f"Task {k}" for k in part])) for part in _PARTS]
        for k, part in enumerate(kinds):
            part.write.parquet(f"{place}/in/{k}")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 << 30)
            upsert_stream(stream.parquet(f"{place}/in/*"), f"{place}/out", f"{place}/state").awaitTermination()
            if k < 2 and not store.compact():
                raise AssertionError("nothing was compacted")
        if store.append(kinds[1], "live", 1):
            raise AssertionError("a replayed batch was stored again")
        _STORES[key] = f"{place}/out"
    return read_results(spark, _STORES[key])


_SHOWN = ["id", "trace_id", "source_ip", "timestamp", "final_prob", "is_anomaly", "detect_type",
          "file_id", "task_name"]
_SQL_SHOWN = ", ".join("round(final_prob, 6) AS final_prob" if n == "final_prob" else n for n in _SHOWN)


@query("upsert_stream", sql(f"SELECT {_SQL_SHOWN} FROM stored", **_VIEWS))
def upsert_streamed(spark, folder):
    return rounded(stored(spark, folder).select(*_SHOWN))


@query("stored_results_page", sql(f"""
    SELECT {_SQL_SHOWN} FROM stored WHERE is_anomaly = 0 AND source_ip LIKE '%1%'
    ORDER BY timestamp DESC, id LIMIT 10 OFFSET 10""", **_VIEWS))
def stored_results_page(spark, folder):
    out = r.results_page(stored(spark, folder), current=2, size=10, is_anomaly=0, source_ip="1")
    return rounded(out.select(*_SHOWN))


@query("stored_statistics", sql("""
    SELECT count(*) FILTER (is_anomaly = 0) AS normal, count(*) FILTER (is_anomaly = 1) AS anomaly,
           count(*) AS total FROM stored WHERE timestamp >= 1704326400000""", **_VIEWS))
def stored_statistics(spark, folder):
    return r.detection_statistics(stored(spark, folder), start=1704326400000)


@query("stored_latest_score", sql("""
    SELECT round(final_prob, 6) AS final_prob FROM stored ORDER BY timestamp DESC, id DESC LIMIT 1""",
    **_VIEWS))
def stored_latest_score(spark, folder):
    return rounded(r.latest_score(stored(spark, folder)))


@query("stored_requests", sql("""
    SELECT s.trace_id, count(p.trace_id) > 0 AS asked FROM stored s
    LEFT JOIN (SELECT DISTINCT trace_id FROM packets WHERE event_type = 'error') p USING (trace_id)
    GROUP BY 1""", **_VIEWS))
def stored_requests(spark, folder):
    """Sessions with an error ask for an explanation; the others are the rest."""
    rows = stored(spark, folder)
    wanted = t.packets(spark, folder).where(F.col("event_type") == "error").select("trace_id")
    found = j.explain_requests(wanted, rows).select("trace_id", F.lit(True).alias("asked"))
    rest = j.missing_requests(rows, wanted).select("trace_id", F.lit(False).alias("asked"))
    return found.unionByName(rest)
