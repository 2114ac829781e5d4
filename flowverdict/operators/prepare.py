"""Model input: category codes, scaling, vectors and exact splits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.records import default_missing
from ..schemas import CATEGORICAL, MODEL_INPUT, NUMERIC, c
from .lineage import written
from .ordering import in_order

MAX_CODES = 10_000
HASH_BINS = 4  # hex digits: 65,536 bins


def fit_label_codes(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Table (column, value, code): distinct values of each column, coded in sorted order."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("value")) for n in columns
    ]))
    values = df.select(pairs).where(F.col("value").isNotNull()).distinct()
    return in_order(values, ["column"], ["value"], index="code")


def code_maps(codes: DataFrame) -> dict[str, dict[str, int]] | None:
    """The codes as dictionaries, or None if there are more than ``MAX_CODES``."""
    rows = codes.take(MAX_CODES + 1)
    if len(rows) > MAX_CODES:
        return None
    out: dict[str, dict[str, int]] = {}
    for row in rows:
        out.setdefault(row["column"], {})[row["value"]] = row["code"]
    return out


def _unseen(found: Column, value: Column, name: str, handle_unseen: str) -> Column:
    if handle_unseen == "error":
        text = F.concat(F.lit(f"unseen value of {name}: "), F.coalesce(value, F.lit("NULL")))
        return F.coalesce(found, F.raise_error(text).cast("double"))
    return F.coalesce(found, F.lit(0.0))


def apply_label_codes(
    df: DataFrame, codes: DataFrame | dict, columns: list[str] = CATEGORICAL,
    handle_unseen: str = "zero",
) -> DataFrame:
    """Replace categories by codes; unseen values become 0, or fail with ``error``.

    Up to ``MAX_CODES`` codes travel as a literal map (no shuffle, also on streams);
    more than that are joined.
    """
    maps = codes if isinstance(codes, dict) else code_maps(codes)
    for name in columns:
        value = c(name).cast("string")
        if maps is not None:
            entries = [F.lit(x) for kv in maps.get(name, {}).items() for x in (kv[0], float(kv[1]))]
            found = F.try_element_at(F.create_map(*entries), value) if entries else F.lit(None)
            df = df.withColumn(name, _unseen(found.cast("double"), value, name, handle_unseen))
        else:
            mine = codes.where(F.col("column") == name).select(
                F.col("value").alias("_value"), F.col("code").cast("double").alias("_code")
            )
            df = df.join(mine, value == F.col("_value"), "left")
            df = df.withColumn(
                name, _unseen(F.col("_code"), value, name, handle_unseen)
            ).drop("_value", "_code")
    return df


@dataclass
class Scaler:
    columns: list[str]
    mean: list[float]
    scale: list[float]


def scaler_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its mean and scale (population deviation, 1 if it is 0)."""
    aggs = [
        F.struct(F.lit(n).alias("column"), F.avg(c(n)).alias("mean"),
                 F.stddev_pop(c(n)).alias("std"))
        for n in columns
    ]
    flat = df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
    return flat.select(
        "column", "mean", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")).alias("scale")
    )


def fit_scaler(df: DataFrame, columns: list[str] = MODEL_INPUT) -> Scaler:
    rows = {r["column"]: r for r in scaler_statistics(df, columns).collect()}
    return Scaler(
        list(columns), [rows[n]["mean"] for n in columns], [rows[n]["scale"] for n in columns]
    )


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({
        n: (c(n) - F.lit(m)) / F.lit(s)
        for n, m, s in zip(scaler.columns, scaler.mean, scaler.scale)
    })


def assemble(df: DataFrame, columns: list[str] = MODEL_INPUT, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[c(n).cast("double") for n in columns])))


@dataclass
class Preparation:
    """Codes and scaler of one model; the scaler belongs to the rows the model saw."""

    codes: dict[str, dict[str, int]] | DataFrame  # a table (column, value, code) beyond MAX_CODES
    scaler: Scaler
    columns: list[str]
    categorical: list[str]

    def apply(self, df: DataFrame, handle_unseen: str = "zero") -> DataFrame:
        """Add the scaled input as the array ``x``; the columns of ``df`` stay."""
        filled = default_missing(df)
        coded = apply_label_codes(
            filled.select(*[c(n) for n in filled.columns],
                          *[c(n).alias(f"_in_{i}") for i, n in enumerate(self.columns)]),
            self._named_codes(), [f"_in_{self.columns.index(n)}" for n in self.categorical],
            handle_unseen,
        )
        x = F.array(*[
            (F.coalesce(F.col(f"_in_{i}").cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
            for i, (m, s) in enumerate(zip(self.scaler.mean, self.scaler.scale))
        ])
        return coded.withColumn("x", x).select(*[c(n) for n in df.columns], "x")


    def _named_codes(self) -> dict[str, dict[str, int]] | DataFrame:
        """The codes by the place of their column in the input."""
        if isinstance(self.codes, dict):
            return {f"_in_{self.columns.index(n)}": self.codes.get(n, {}) for n in self.categorical}
        place = F.create_map(*[F.lit(x) for n in self.categorical
                               for x in (n, f"_in_{self.columns.index(n)}")])
        return self.codes.withColumn("column", F.element_at(place, F.col("column")))


def fit_preparation(
    df: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL
) -> Preparation:
    columns = list(numeric) + list(categorical)
    codes = fit_label_codes(df, categorical)
    maps = code_maps(codes)
    if maps is None:
        maps = written(codes, "codes")
    coded = apply_label_codes(df, maps, categorical)
    return Preparation(maps, fit_scaler(coded, columns), columns, list(categorical))


def _hash(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def exact_parts(
    df: DataFrame, key: str, fractions: list[float], by: str | None = None, seed: int = 42
) -> DataFrame:
    """Add ``part``: rows of each class cut into exact shares in hash order of ``key``.

    A rank over a whole class would sort it in one place. Here the classes are counted in
    65,536 hash bins; only bins that a cut falls into are ranked row by row, all other
    rows learn their part from their bin.
    """
    cls = F.lit("") if by is None else F.coalesce(F.col(by).cast("string"), F.lit(""))
    rows = df.withColumn("_class", cls).withColumn("_hash", _hash(key, seed))
    rows = rows.withColumn("_bin", F.substring("_hash", 1, HASH_BINS))
    counts = rows.groupBy("_class", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_class").orderBy("_bin")
    whole = Window.partitionBy("_class")
    shares = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]
    cuts = F.array(*[
        F.round(F.sum("_n").over(whole) * F.lit(float(s))).cast("long") for s in shares
    ]) if shares else F.array().cast("array<bigint>")
    bins = counts.select(
        "_class", "_bin", (F.sum("_n").over(run) - F.col("_n")).alias("_lo"),
        F.sum("_n").over(run).alias("_hi"), cuts.alias("_cuts"),
    ).withColumn(
        "_split",
        F.exists("_cuts", lambda x: (x > F.col("_lo")) & (x < F.col("_hi"))),
    )
    # At most 65,536 rows per class; joined without a hint.
    joined = rows.join(bins, ["_class", "_bin"])

    def part(rank):
        return F.size(F.filter("_cuts", lambda x: x <= rank))

    w = Window.partitionBy("_class", "_bin").orderBy("_hash", key)
    sure = joined.where(~F.col("_split")).withColumn("part", part(F.col("_lo")))
    close = joined.where("_split").withColumn(
        "part", part(F.col("_lo") + F.row_number().over(w) - 1)
    )
    return sure.unionByName(close).select(*df.columns, "part")


def stratified_split(
    df: DataFrame, fractions: list[float], key: str, by: str, seed: int = 42
) -> DataFrame:
    """Exact shares of every class, e.g. [0.8, 0.2] or [0.6, 0.2, 0.2]."""
    return exact_parts(df, key, fractions, by, seed)


def parts_of(df: DataFrame, n: int) -> list[DataFrame]:
    return [df.where(F.col("part") == i).drop("part") for i in range(n)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
