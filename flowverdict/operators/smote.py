"""Class balance by interpolation between minority neighbours (Chawla et al. 2002)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import checkpointed
from .neighbours import nearest_vectors
from .prepare import exact_parts


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` only, so reruns agree."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def smote(df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows ``(_id, x, y)`` plus new minority rows up to class parity.

    A new row is ``x + u * (neighbour - x)`` for one of the k nearest minority rows. The
    neighbours are exact at any size; copies of a vector are its neighbours at distance 0.
    """
    rows = df.select(F.col("_id").cast("string").alias("_id"), "x", "y")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return rows
    rare = min(sizes, key=lambda y: (sizes[y], -y))
    few = sizes[rare]
    missing = max(sizes.values()) - few
    if missing == 0 or few < 2:
        return rows
    k = min(k, few - 1)
    minority = rows.where(F.col("y") == rare)
    vectors = checkpointed(
        minority.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    )
    near = nearest_vectors(vectors, k)
    # The list of one row: its own copies first, then each neighbour with its copies.
    own = F.array_repeat(F.col("x"), F.least(F.col("m") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(
        "near", lambda v: F.array_repeat(v["x"], F.least(v["m"], F.lit(k)).cast("int"))
    ))
    near = near.select("x", F.slice(F.concat(own, others), 1, k).alias("near"))
    each, extra = divmod(missing, few)
    seeds = exact_parts(minority, "_id", [extra / few, 1 - extra / few], seed=seed)
    copies = F.lit(each) + F.when(F.col("part") == 0, 1).otherwise(0)
    made = (
        seeds.where(copies > 0)
        .join(near, "x")
        .select("_id", "x", "near", F.explode(F.sequence(F.lit(1), copies)).alias("i"))
    )
    pick = F.pmod(F.xxhash64(F.col("_id"), F.col("i"), F.lit(seed)), F.size("near")).cast("int")
    made = made.withColumn("_to", F.get("near", pick)).withColumn(
        "_u", uniform(F.col("_id"), F.col("i"), F.lit(seed + 1))
    )
    new = made.select(
        F.concat_ws("~", "_id", F.col("i").cast("string")).alias("_id"),
        F.zip_with("x", "_to", lambda a, b: a + F.col("_u") * (b - a)).alias("x"),
        F.lit(rare).cast(dict(df.dtypes)["y"]).alias("y"),
    )
    return rows.unionByName(new)
