"""Row order inside groups, safe for groups of any size.

A window keeps each group in one task. That is right for ordinary groups and wrong for a group
that holds a large share of the table. ``in_order`` writes its input once and counts it. A table
of few rows has no group that could trouble a task. A larger one is range-partitioned by key and
order into parts of bounded size, whatever the keys; the window runs per (key, part), and keys
that lie in several parts are stitched with one row per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import written

PART_ROWS = 2_000_000


def in_order(
    df: DataFrame,
    key: list[str],
    order: list[str],
    index: str | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Add the position of each row and values of its neighbours inside its group.

    ``order`` names columns of any orderable type that order a group totally (ascending, no
    NULLs). ``index`` names a new 0-based position; ``previous`` and ``following`` map new
    columns to the columns they are taken from, NULL at either end. An empty ``key`` makes the
    whole table one group.
    """
    previous, following = previous or {}, following or {}
    whole = not key
    if whole:
        key = ["_all"]
        df = df.withColumn("_all", F.lit(0))

    def local(frame, group):
        w = Window.partitionBy(*group).orderBy(*order)
        out = frame.withColumn("_pos", F.row_number().over(w).cast("long") - 1)
        for new, old in previous.items():
            out = out.withColumn(new, F.lag(F.col(f"`{old}`")).over(w))
        for new, old in following.items():
            out = out.withColumn(new, F.lead(F.col(f"`{old}`")).over(w))
        return out

    if df.isStreaming:
        out = local(df, key)
    else:
        held = written(df, "unordered")
        parts = -(-held.count() // part_rows)
        out = local(held, key) if parts <= 1 else _stitched(
            held, key, order, previous, following, local, parts)
    out = out.withColumnRenamed("_pos", index) if index else out.drop("_pos")
    return out.drop("_all") if whole else out


def _stitched(df, key, order, previous, following, local, parts):
    # Written, as each run of a range partitioning samples its own bounds.
    ranged = written(
        df.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    point = F.struct(*[F.col(o) for o in order])

    def ends(pairs):
        return F.struct(F.lit(True).alias("_there"),
                        *[F.col(f"`{old}`").alias(new) for new, old in pairs.items()])

    # The keys that a bound cuts, and their rows for each part: at most two a part.
    several = ranged.groupBy(*key).agg(
        F.min("_part").alias("_from"), F.max("_part").alias("_to")).where("_from < _to")
    cut_keys = ranged.join(F.broadcast(several.drop("_from", "_to")), key, "left_semi")
    borders = cut_keys.groupBy(*key, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(ends(previous), point).alias("_last"),
        F.min_by(ends(following), point).alias("_first"),
    )
    w = Window.partitionBy(*key).orderBy("_part")
    borders = borders.select(
        *key,
        "_part",
        F.col("_n"),
        F.coalesce(
            F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.lag("_last").over(w).alias("_last"),
        F.lead("_first").over(w).alias("_first"),
    )
    # One column, as a caller's new columns may have any of these names.
    borders = borders.select(*key, "_part", F.struct("_n", "_before", "_last", "_first").alias("_border"))
    out = local(ranged, [*key, "_part"]).join(F.broadcast(borders), [*key, "_part"], "left")
    border = F.col("_border")
    at_start = border["_n"].isNotNull() & (F.col("_pos") == 0)
    at_end = border["_n"].isNotNull() & (F.col("_pos") == border["_n"] - 1)
    for new in previous:
        out = out.withColumn(new, F.when(at_start, border["_last"][new]).otherwise(F.col(new)))
    for new in following:
        out = out.withColumn(new, F.when(at_end, border["_first"][new]).otherwise(F.col(new)))
    out = out.withColumn("_pos", F.col("_pos") + F.coalesce(border["_before"], F.lit(0)))
    return out.drop("_part", "_border")
