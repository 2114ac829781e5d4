"""Connected components of a table of links.

Links are first contracted by tasks of bounded size: each replaces its own links by stars that
connect the same nodes. What still chains over several tasks is resolved by alternating stars
(Kiveris et al., 2014), whose rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

# Rows up to which a narrow table is sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 200_000
LINKS_A_TASK = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast of a narrow written table where its row count is within the bound."""
    return F.broadcast(df) if df.count() <= most else df


def stars(links) -> list[tuple]:
    """``(node, smallest node)`` of every node but the smallest of each component of ``links``."""
    above: dict = {}

    def top(x):
        while x in above:
            up = above[x]
            if up in above:
                above[x] = above[up]
            x = up
        return x

    nodes = set()
    for u, v in links:
        nodes.update((u, v))
        a, b = top(u), top(v)
        if a != b:
            above[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in nodes if x in above]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        rows = []
        for batch in batches:
            kind = batch.schema
            rows += zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())
        if rows:
            u, v = list(zip(*stars(rows)))
            yield pa.record_batch([pa.array(u, kind[0].type), pa.array(v, kind[1].type)], ["u", "v"])

    return links.repartition(tasks).mapInArrow(contract, links.schema)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (u, v)``; the root is the smallest node.

    The smallest neighbours are written before they are joined: a node with very many links is
    then a skewed join that adaptive execution splits.
    """
    links = cut(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    tasks = max(1, -(-links.count() // LINKS_A_TASK))
    links = cut(_contracted(links, tasks), "contracted")
    if tasks > 1:
        left = max(1, -(-links.count() // LINKS_A_TASK))
        links = cut(_contracted(links, left), "contracted")
        tasks = left
    while tasks > 1 and not _are_stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
            "least")
        large = cut(
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least, "u")
        links = cut(
            joined.select("u", F.col("m").alias("v"))
            .union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link upwards and none leads to a node that has one itself."""
    several = links.groupBy("u").count().where("count > 1").select("u")
    chained = links.select(F.col("v").alias("u")).distinct().join(links.select("u").distinct(), "u", "left_semi")
    return several.union(chained).isEmpty()
