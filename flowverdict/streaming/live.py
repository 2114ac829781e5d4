"""Live counts and the state of explanation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.lineage import checkpointed
from ..operators.ordering import PART_ROWS, in_order
from ..operators.results import live_counters, per_second_rates, status_code
from ..sources.batches import BatchStore

def stream_rates(results: DataFrame, late: str) -> DataFrame:
    """Counts per second of event time as a stream. Rows later than ``late`` are not counted; to
    count all of them, use ``write_rates``."""
    return per_second_rates(results.withWatermark("event_time", late))


class RateStore(BatchStore):
    """Counts per second of event time, however late a row comes.

    A batch stores the counts of its own rows; a reader adds up the batches over the base. A late
    row thus corrects the second it belongs to, no stream keeps state, and nothing is dropped.
    """

    schema = T.StructType([T.StructField("second", T.TimestampType()), T.StructField("qps", T.LongType()),
                           T.StructField("anomalies", T.LongType())])

    def prepared(self, rows: DataFrame, number: int) -> DataFrame:
        return per_second_rates(rows.where(F.col("event_time").isNotNull()))

    def merged(self, base: DataFrame | None, changed: DataFrame) -> DataFrame:
        def added(rows: DataFrame) -> DataFrame:
            return rows.groupBy("second").agg(
                *[F.sum(n).alias(n) for n in ("qps", "anomalies")], F.max("_batch").alias("_batch"))

        if base is None:
            return added(changed)
        seconds = changed.select("second").distinct()
        return base.join(seconds, "second", "left_anti").unionByName(
            added(changed.unionByName(base.join(seconds, "second", "left_semi"))))

    def corrected(self, since: int) -> DataFrame:
        """Seconds that batches after number ``since`` have counted in, with their counts now:
        what a reader that showed them has to replace."""
        return self._merged(self._state()).where(F.col("_batch") > since).drop("_batch")


def write_rates(
    results: DataFrame, path: str, checkpoint: str, stream: str = "live", trigger: dict | None = None,
):
    """Keep the counts per second of a stream (``event_time``, ``is_anomaly``) at ``path``."""
    store = RateStore(results.sparkSession, path)
    return (
        results.writeStream.foreachBatch(lambda rows, batch: store.append(rows, stream, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return RateStore(spark, path).read()


def stream_counters(results: DataFrame, now: int | None = None, start=None, end=None) -> DataFrame:
    """Running totals; write in complete mode. Without ``now`` the clock goes on with the
    micro-batches."""
    return live_counters(results, now, start, end)


_SUMMARY = T.StructType([T.StructField(n, t, True) for n, t in [
    ("trace_id", T.StringType()),
    ("before", T.IntegerType()), ("before_done", T.BooleanType()), ("before_payload", T.StringType()),
    ("after", T.IntegerType()), ("after_done", T.BooleanType()), ("after_payload", T.StringType()),
    ("starts", T.LongType()), ("at", T.TimestampType()),
]])


def lifecycle_summaries(events: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """What the events of a batch do to each request: one row per trace.

    ``before``: the last state that results and errors ahead of the batch's first request lead
    to, ``after``: that from the first request on (NULL without events there); ``*_done`` and
    ``*_payload``: whether there is a result, and the payload of the last one; ``starts``: jobs
    that requests after the first one start. ``events``: trace_id, ord, kind, payload.
    """
    first = events.groupBy("trace_id").agg(
        F.min(F.when(F.col("kind") == "request", F.col("ord"))).alias("_first"))
    rows = in_order(events, ["trace_id"], ["ord"], previous={"_before": "kind"}, part_rows=part_rows)
    rows = rows.join(first, "trace_id")
    early = F.col("_first").isNull() | (F.col("ord") < F.col("_first"))
    again = (F.col("kind") == "request") & (F.col("ord") > F.col("_first")) & (F.col("_before") != "request")
    out = []
    for name, here in (("before", early), ("after", ~early)):
        done = F.when(here & (F.col("kind") == "result"), F.col("ord"))
        out += [
            F.max_by(status_code(F.col("kind")), F.when(here, F.col("ord"))).alias(name),
            F.max(done).isNotNull().alias(f"{name}_done"),
            F.max_by("payload", done).alias(f"{name}_payload"),
        ]
    return rows.groupBy("trace_id").agg(*out, F.count(F.when(again, 1)).alias("starts"))


_STATE = "struct<seen: boolean, status: int, payload: string, jobs: bigint>"


def _step(s: Column, x: Column) -> Column:
    """The state ``s`` of a request after the summary ``x`` of a batch."""
    early, late = s["seen"] & x["before"].isNotNull(), x["after"].isNotNull()
    status = F.when(early, x["before"]).otherwise(s["status"])
    payload = F.when(s["seen"] & x["before_done"], x["before_payload"]).otherwise(s["payload"])
    started = x["starts"] + F.when(s["seen"] & (status == 0), F.lit(0)).otherwise(F.lit(1))
    return F.struct(
        (s["seen"] | late).alias("seen"),
        F.when(late, x["after"]).otherwise(status).alias("status"),
        F.when(late & x["after_done"], x["after_payload"]).otherwise(payload).alias("payload"),
        (s["jobs"] + F.when(late, started).otherwise(F.lit(0))).cast("long").alias("jobs"),
    ).cast(_STATE)


class LifecycleStore(BatchStore):
    """The state of every explanation request, from the summaries of the batches of its events.

    A batch stores one row per trace, however many events it has; between two compactions a
    reader folds one row per trace and batch. A finished request may be forgotten when the
    store is compacted (``forget``), so its state ends; its results that come later are then
    those of an unknown request.
    """

    schema = _SUMMARY

    def prepared(self, rows: DataFrame, number: int) -> DataFrame:
        return lifecycle_summaries(checkpointed(rows.select("trace_id", "ord", "kind", "payload"))).withColumn(
            "at", F.current_timestamp())

    def merged(self, base: DataFrame | None, changed: DataFrame) -> DataFrame:
        rows = changed if base is None else base.unionByName(changed)
        parts = F.array_sort(F.collect_list(F.struct("_batch", *[n for n in changed.columns if n not in (
            "trace_id", "_batch")])))
        start = F.struct(F.lit(False), F.lit(-1), F.lit(None).cast("string"), F.lit(0).cast("long")).cast(_STATE)
        folded = rows.groupBy("trace_id").agg(
            F.aggregate(parts, start, _step).alias("s"), F.max("at").alias("at"), F.max("_batch").alias("_batch"))
        # A state is the summary of one request and all that followed it.
        none = F.lit(None)
        return folded.where("s.seen").select(
            "trace_id", none.cast("int").alias("before"), F.lit(False).alias("before_done"),
            none.cast("string").alias("before_payload"), F.col("s.status").alias("after"),
            F.lit(True).alias("after_done"), F.col("s.payload").alias("after_payload"),
            (F.col("s.jobs") - 1).alias("starts"), "at", "_batch",
        )

    def read(self) -> DataFrame:
        """``trace_id, status, payload, jobs`` of all requests."""
        state = self._state()
        rows = self._merged(state)
        return rows.select("trace_id", F.col("after").alias("status"), F.col("after_payload").alias("payload"),
                           (F.col("starts") + 1).alias("jobs"))

    def forget(self, finished_before: str) -> bool:
        """Compacts, without the requests that are done or failed and had no event since the
        time ``finished_before``."""
        return self.compact((F.col("after") == 0) | (F.col("at") >= F.lit(finished_before).cast("timestamp")))


def write_explain_lifecycle(
    events: DataFrame, path: str, checkpoint: str, stream: str = "explain", trigger: dict | None = None,
):
    """Keep the state of the requests of an event stream in the ``LifecycleStore`` at ``path``.

    Events of a trace must arrive in order, as in a queue; how they are cut into batches does
    not matter, and a replayed batch changes nothing. ``events``: trace_id, ord, kind, payload.
    """
    store = LifecycleStore(events.sparkSession, path)
    return (
        events.writeStream.foreachBatch(lambda rows, batch: store.append(rows, stream, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_explain_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    """``trace_id, status, payload, jobs`` of all requests seen so far."""
    return LifecycleStore(spark, path).read()
