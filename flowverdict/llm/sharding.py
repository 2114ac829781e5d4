"""Sharding by jump consistent hashing (law: key).

A key's shard is a function of the key and the number of shards alone: no ring table is kept,
and one more shard takes rows only into itself, about 1 in (shards + 1) of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, unused, with_ranks
from .registry import query

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys (Lamping and Veach, 2014), all keys at once.

    Each key walks through the shard counts at which it would have moved; the last one below
    ``shards`` is its place. A key moves at most ``shards - 1`` times.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    keys = keys.astype(np.uint64)
    place, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    while len(moving):
        place[moving] = ahead[moving]
        keys[moving] = keys[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (keys[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((place[moving] + 1) * ((1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return place


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column of any type; equal keys share a shard, NULL is a key as well."""

    @F.pandas_udf("int")
    def place(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards).astype(np.int32))

    return place(F.xxhash64(key))


def sharded(docs: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``grown_shard`` (with one shard more) added.

    Both names get a leading ``_`` where ``docs`` has them already.
    """
    shard, grown = unused(docs, "shard", "grown_shard")
    return docs.withColumns(
        {shard: shard_of(docs[key], shards), grown: shard_of(docs[key], shards + 1)}
    )


def write_shards(docs: DataFrame, key: str, path: str, shards: int = SHARDS) -> None:
    """Writes the rows below ``path``, one folder ``shard=N`` for each shard that has rows.

    Every task writes its own rows of a shard, so nothing is shuffled and no shard has to fit
    into one task. A column ``shard`` of ``docs`` itself is written as ``_shard``.
    """
    clash = [c for c in docs.columns if c.lower() == "shard"]
    placed = shard_of(docs[key], shards)
    for c in clash:
        docs = docs.withColumnRenamed(c, unused(docs, c)[0])
    docs.withColumn("shard", placed).write.partitionBy("shard").parquet(path)


def manifest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where each row of ``docs (doc_id, text)`` goes: shard, slot in it, size and checksum.

    A NULL text has size 1 and the checksum of an empty text. Repeated rows each get a slot;
    rows whose id is NULL share a shard. An empty table gives no rows.
    """
    body = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
    )
    ranked = with_ranks(sharded(rows, "doc_id", shards), ["shard"], "slot", docs.count())
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
    )


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))
