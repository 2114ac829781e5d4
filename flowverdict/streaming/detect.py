"""Live detection: messages in, rows of the verdict table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.detect import Models, infer
from ..sources.messages import message_rows, parse_messages
from ..sources.verdicts import VerdictStore


def detect_stream(messages: DataFrame, models: Models, mode: str = "adaptive") -> DataFrame:
    """Verdict and echoed fields of every good message. Stateless; batch or stream."""
    return _verdicts(message_rows(parse_messages(messages)), models, mode)


def _verdicts(rows: DataFrame, models: Models, mode: str) -> DataFrame:
    return infer(rows, models, mode).select(
        "trace_id", "source_ip", "timestamp", "rf_prob", "gcn_prob", "final_prob", "is_anomaly",
        F.struct("mode", "threshold", "weight_rf").alias("fusion_info"),
        "features_json", "call_graph_json", F.lit(0).alias("detect_type"),
    )


def write_detect_results(
    messages: DataFrame, models: Models, path: str, checkpoint: str, mode: str = "adaptive",
    trigger: dict | None = None, stream: str = "live",
):
    """Score a message stream into the verdict table at ``path``, and texts that do not parse
    beside it.

    Each micro-batch is one batch of ``stream`` there (``VerdictStore.append``): a replayed
    batch changes nothing, a known trace gets a newer row and keeps its id, and nothing stored
    is rewritten while the stream runs.
    """
    store = VerdictStore(messages.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(batch).persist()
        store.append(_verdicts(message_rows(parsed), models, mode), stream, batch_id)
        parsed.where("bad").select("value").write.mode("overwrite").parquet(
            f"{path}/bad_messages/batch_id={batch_id}"
        )
        parsed.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def upsert_stream(results: DataFrame, path: str, checkpoint: str, stream: str = "live",
                  trigger: dict | None = None):
    """Write a stream of verdict rows into the verdict table at ``path``, as
    ``write_detect_results`` does."""
    store = VerdictStore(results.sparkSession, path)
    return (
        results.writeStream.foreachBatch(lambda rows, batch: store.append(rows, stream, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored verdicts of all streams and tasks, the newest per trace."""
    return VerdictStore(spark, path).read()


def compact_results(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Merge the batches written so far into a new base, which readers take from then on; run
    now and then, also while streams write. With ``target`` a copy of all rows is written
    there."""
    VerdictStore(spark, path).compact()
    if target is not None:
        read_results(spark, path).write.mode("overwrite").parquet(target)
