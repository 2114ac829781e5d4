"""Shared helpers of the corpus operators: tables, written cuts, gapless ranks."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; elsewhere a missing
    setting is an error, because a folder of one machine is not seen by the others.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            known = context._jsc.sc().getCheckpointDir()
        folder = known.get()
    return folder.rstrip("/")


BATCH_BYTES = 8 << 20
_DEFAULT_BYTES = ("67108864", "67108864b", "64MB")


def bounded_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python in batches of at most ``BATCH_BYTES``, unless the session
    has a limit of its own: the tasks of a job hold several copies of a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in _DEFAULT_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what malloc and Arrow keep for themselves to the system.

    A worker goes on to the tasks of the next stage; what it kept would be missing there.
    """
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(read: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``read`` over the batches of a task; its memory is given back when they end."""
    def whole(batches: Iterator) -> Iterator:
        yield from read(batches)
        give_back()

    return whole


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def learnt_from(doc_id: Column, modulus: int, held_out: int) -> Column:
    """True where a row's labels or text may be learnt from; ids that are NULL count as ''."""
    return ~is_held_out(doc_id, modulus, held_out)


def is_held_out(doc_id: Column, modulus: int, held_out: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == held_out


# Rows of one bucket of a rank: what one task numbers at a time.
RANK_ROWS = 4096


def with_ranks(df: DataFrame, group: list[str], rank: str, rows: int | None = None) -> DataFrame:
    """Adds ``rank``, gapless from 0 in every ``group``; equal rows get neighbouring ranks.

    A window over the group would number a hot group in one task. Here equal rows are counted
    first (before the shuffle), the distinct rows of a group are dealt into buckets by their
    hash, buckets get their first rank from the counts, and only a bucket is numbered in one
    task. All columns of ``df`` must be orderable.
    """
    copies, bucket, first, before = unused(df, "copies", "bucket", "first", "before")
    rows = df.count() if rows is None else rows
    buckets = max(32, -(-rows // RANK_ROWS))
    counted = (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))
        .withColumn(bucket, F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    )
    of_group = Window.partitionBy(*group).orderBy(bucket)
    firsts = (
        counted.groupBy(*group, bucket).agg(F.sum(copies).alias(first))
        .withColumn(first, F.sum(first).over(of_group) - F.col(first))
    )
    joined = counted.join(firsts, [*group, bucket])
    inside = Window.partitionBy(*group, bucket).orderBy(*df.columns)
    numbered = joined.withColumn(
        before, F.col(first) + F.sum(copies).over(inside) - F.col(copies)
    )
    ranks = F.sequence(F.col(before), F.col(before) + F.col(copies) - 1)
    return numbered.select(*df.columns, F.explode(ranks).alias(rank))
