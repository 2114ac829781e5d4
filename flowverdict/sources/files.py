"""Feature, graph and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.results import first_by_id
from ..schemas import FEATURES, GRAPH_FILE, MODEL_INPUT, NUMERIC, TOPOLOGY, c

# Texts that mean a missing value in a feature file.
MISSING = ["", "NaN", "nan", "NA", "N/A", "null", "NULL", "None"]
FILE_ORDER = ["_file", "_block", "_line"]


def _file_order() -> dict:
    """Columns that order rows as they stand in their files: a block is read by one task
    from front to back."""
    return {
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_line": F.monotonically_increasing_id(),
    }


def read_feature_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of feature CSVs with their place in the files.

    Columns are found by their header, whatever their order, and cast by the fixed schema;
    columns outside it stay strings. Missing values become NULL. All files of a folder must
    have the same header: one that differs fails the read, as its values would otherwise stand
    in the wrong columns.
    """
    reader = spark.read.option("header", True)
    header = T.StructType([T.StructField(n, T.StringType()) for n in reader.csv(path).columns])
    raw = reader.option("enforceSchema", False).schema(header).csv(path).withColumns(_file_order())
    types = {f.name: f.dataType for f in FEATURES.fields}
    out = []
    for name in raw.columns:
        if name in FILE_ORDER:
            out.append(F.col(name))
            continue
        text = F.when(~F.trim(c(name)).isin(MISSING), c(name))
        if name in NUMERIC or name in TOPOLOGY:
            text = F.trim(text).try_cast(types[name])
        out.append(text.alias(name))
    return raw.select(*out)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``_id``, the first of the file, and the number of ``copies`` it has."""
    return first_by_id(read_feature_rows(spark, path), FILE_ORDER)


def read_call_graphs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Graphs by ``_id``; the last of a repeated id wins, a missing list is empty.

    The usual file is one JSON array, which one task must read; ``lines`` takes JSON lines,
    which split.
    """
    raw = spark.read.schema(GRAPH_FILE).option("multiLine", not lines).json(path)
    graph = F.coalesce("call_graph", F.array().cast(GRAPH_FILE["call_graph"].dataType))
    rows = raw.withColumns(_file_order()).withColumn("call_graph", graph)
    return rows.where(F.col("_id").isNotNull()).groupBy("_id").agg(
        F.max_by("call_graph", F.struct(*FILE_ORDER)).alias("call_graph")
    )


def export_features(df: DataFrame, path: str) -> None:
    """CSV folder with the original column names, without label and source address."""
    df.select("_id", *[c(n) for n in MODEL_INPUT], *TOPOLOGY).write.csv(path, header=True)


def export_graphs(df: DataFrame, path: str) -> None:
    df.select("_id", "call_graph").write.json(path)


def export_metrics(df: DataFrame, path: str) -> None:
    """The table as JSON lines and as CSV, side by side."""
    df.write.json(f"{path}/json")
    df.write.csv(f"{path}/csv", header=True)


def append_task_results(df: DataFrame, path: str) -> None:
    """Append the tagged records of a task to the stored verdicts."""
    df.write.mode("append").parquet(path)
