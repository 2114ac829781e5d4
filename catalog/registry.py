"""Register of queries: a Spark callable and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(call):
        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return call

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, as in the SQL forms: sums may differ in the last bits."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double"
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
