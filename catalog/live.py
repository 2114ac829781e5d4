"""Queries that run as streams over the tables and are read back when they are done."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowverdict.operators import joins as j
from flowverdict.operators.lineage import shared_folder
from flowverdict.sources import tables as t
from flowverdict.streaming import detect as sd, live

from .learning import graph_rows, models
from .registry import query, rounded
from .stored import explain_events
from .traffic import features
from .views import sql


def table_stream(spark, folder, name):
    """A warehouse table as a stream of files."""
    schema = t.table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(
        folder)


class _Streamed:
    """Stands in for ``spark.read`` so that the derived tables are built on streams."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path):
        folder, name = path.rsplit("/", 1)
        return table_stream(self.spark, folder, name[: -len(".parquet")])


def run_updates(stream, spark, name):
    """Run a stream in update mode to its end; all updates with their ``batch_id``."""
    folder = shared_folder(spark, name)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{folder}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_rates", sql("""
    SELECT epoch_ms(date_trunc('second', event_time)) AS second, count(*) AS qps,
           count(*) FILTER (is_anomaly = 1) AS anomalies FROM results GROUP BY 1"""))
def stream_rates(spark, folder):
    updates = run_updates(live.stream_rates(t.results(_Streamed(spark), folder), "10 seconds"), spark, "rates")
    newest = updates.groupBy("second").agg(
        F.max_by(F.struct("qps", "anomalies"), "batch_id").alias("r"))
    return newest.select(F.unix_millis("second").alias("second"), "r.*")


@query("late_rates", sql("""
    SELECT epoch_ms(date_trunc('second', event_time)) AS second, count(*) AS qps,
           count(*) FILTER (is_anomaly = 1) AS anomalies FROM results GROUP BY 1"""))
def late_rates(spark, folder):
    """Events of one kind after those of another, so that most rows come late, with a compaction
    in between."""
    place = shared_folder(spark, "late")
    rows = t.results(spark, folder).select("event_time", "is_anomaly", "task_name")
    for k, kinds in enumerate((["click", "error"], ["view", "signup"], ["purchase"])):
        rows.where(F.col("task_name").isin([f"Task {x}" for x in kinds])).write.parquet(f"{place}/in/{k}")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 << 30)
        live.write_rates(stream.parquet(f"{place}/in/*"), f"{place}/out", f"{place}/state").awaitTermination()
        if k == 1:
            live.RateStore(spark, f"{place}/out").compact()
    return live.read_rates(spark, f"{place}/out").withColumn("second", F.unix_millis("second"))


@query("stream_counters", sql("""
    SELECT count(*) AS total, count(*) FILTER (is_anomaly = 1) AS anomaly
    FROM results WHERE timestamp >= 1704326400000"""))
def stream_counters(spark, folder):
    stream = live.stream_counters(t.results(_Streamed(spark), folder), now=1705752000000,
                                  start=1704326400000)
    updates = run_updates(stream, spark, "counters")
    return updates.agg(F.max_by(F.struct("total", "anomaly"), "batch_id").alias("r")).select("r.*")


@query("stream_explain_lifecycle", sql("""
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
def stream_explain_lifecycle(spark, folder):
    place = shared_folder(spark, "explanations")
    live.write_explain_lifecycle(
        explain_events(_Streamed(spark), folder), f"{place}/out", f"{place}/state").awaitTermination()
    return live.read_explain_lifecycle(spark, f"{place}/out")


def messages(spark, folder):
    """Session records as message texts; a broken text per session of a 172.* address."""
    broken = F.col("source_ip").startswith("172.")
    rows = features(spark, folder)
    texts = j.to_request_messages(
        rows, graph_rows(spark, folder), F.col("source_ip"), F.lit(1705752000000).cast("long")
    )
    marked = texts.join(rows.select(F.col("_id").alias("trace_id"), broken.alias("b")), "trace_id")
    return marked.select(
        F.when(F.col("b"), F.concat(F.lit("{"), "value")).otherwise(F.col("value")).alias("value")
    )


@query("detect_stream")
def detect_stream(spark, folder):
    """Messages written to files, streamed, scored, stored, and read back."""
    place = shared_folder(spark, "messages")
    messages(spark, folder).write.text(f"{place}/in")
    from flowverdict.sources.messages import read_detect_requests

    run = sd.write_detect_results(
        read_detect_requests(spark, f"{place}/in"), models(spark, folder), f"{place}/out",
        f"{place}/state",
    )
    run.awaitTermination()
    out = sd.read_results(spark, f"{place}/out")
    return rounded(out.select("trace_id", "source_ip", "timestamp", "rf_prob", "gcn_prob",
                              "final_prob", "is_anomaly", "mode"))


@query("bad_messages", sql("""
    SELECT count(*) FILTER (source_ip LIKE '172.%') AS bad,
           count(*) FILTER (source_ip NOT LIKE '172.%') AS good FROM sessions"""))
def bad_messages(spark, folder):
    from flowverdict.sources.messages import split_bad_messages

    good, bad = split_bad_messages(messages(spark, folder))
    return bad.agg(F.count("value").alias("bad")).withColumn(
        "good", good.agg(F.count(F.lit(1))).scalar())
