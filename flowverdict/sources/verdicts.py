"""The verdict table: live, file and capture rows in one place, merged when it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.lineage import checkpointed
from ..schemas import VERDICT
from .batches import BatchStore

# A batch owns a block of 2^40 ids, a bucket of its traces 2^20 of them.
BATCH_IDS, BUCKET_IDS = 40, 20
BUCKET_ROWS = 1 << 16  # traces of a bucket on average


def as_verdicts(df: DataFrame) -> DataFrame:
    """``df`` with the columns of the verdict table but the id; those it lacks are NULL."""
    fusion = "fusion_info" in df.columns
    names = [f for f in VERDICT.fields if f.name != "id"]
    out = []
    for f in names:
        if f.name in df.columns:
            value = F.col(f.name)
        elif fusion and f.name in ("mode", "threshold", "weight_rf"):
            value = F.col(f"fusion_info.{f.name}")
        else:
            value = F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def newest_of_batch(rows: DataFrame) -> DataFrame:
    """One row per trace: the latest time stamp, then the larger values, column by column."""
    names = [n for n in rows.columns if n != "trace_id"]
    order = F.struct("timestamp", *[n for n in names if n != "timestamp"])
    newest = rows.groupBy("trace_id").agg(F.max_by(F.struct(*names), order).alias("_r"))
    return newest.select("trace_id", "_r.*").select(*rows.columns)


def with_ids(rows: DataFrame, number: int) -> DataFrame:
    """Ids of the block of batch ``number`` for rows of distinct traces.

    Traces are dealt into buckets by their hash and numbered inside them, by as many tasks as
    there are buckets. The same rows always get the same ids.
    """
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    if buckets > 1 << (BATCH_IDS - BUCKET_IDS):
        raise ValueError("a batch of so many traces has to be cut")
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("trace_id"))
    block = F.lit(number << BATCH_IDS) + F.col("_bucket") * F.lit(1 << BUCKET_IDS)
    marked = rows.withColumn("_bucket", bucket)
    return marked.select((block + rank).cast("long").alias("id"), *rows.columns)


class VerdictStore(BatchStore):
    """Verdicts, the newest row per trace; a known trace keeps its id.

    The rows of a batch may lack columns of the table and need no id.
    """

    schema = VERDICT

    def prepared(self, rows: DataFrame, number: int) -> DataFrame:
        return with_ids(checkpointed(newest_of_batch(as_verdicts(rows))), number)

    def merged(self, base: DataFrame | None, changed: DataFrame) -> DataFrame:
        names = [n for n in changed.columns if n not in ("trace_id", "id")]

        def newest(rows: DataFrame) -> DataFrame:
            merged = rows.groupBy("trace_id").agg(
                F.max_by(F.struct(*names), "_batch").alias("_r"), F.min("id").alias("id"))
            return merged.select("id", "trace_id", "_r.*").select(*changed.columns)

        if base is None:
            return newest(changed)
        # Only the stored rows of changed traces meet the batches; the others are read as they are.
        traces = changed.select("trace_id").distinct()
        same = base["trace_id"].eqNullSafe(traces["trace_id"])
        return base.join(traces, same, "left_anti").unionByName(
            newest(changed.unionByName(base.join(traces, same, "left_semi"))))
