"""Streams of detection messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import MESSAGE

_CORRUPT = "_corrupt"
_PARSED = T.StructType(MESSAGE.fields + [T.StructField(_CORRUPT, T.StringType(), True)])


def read_detect_requests(
    spark: SparkSession, path: str | None = None, kafka: dict | None = None,
    max_files: int = 100,
) -> DataFrame:
    """Stream with the message text in ``value``: JSON lines in a folder, or a Kafka topic.

    ``kafka`` holds source options (``kafka.bootstrap.servers``, ``subscribe``, ...); the
    connector must be on the class path.
    """
    if kafka is not None:
        stream = spark.readStream.format("kafka").options(**kafka).load()
        return stream.select(F.col("value").cast("string").alias("value"))
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Message fields beside the text; ``bad`` marks texts that do not parse."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = messages.withColumn("m", F.from_json("value", _PARSED, options))
    return parsed.withColumn("bad", F.col("m").isNull() | F.col(f"m.{_CORRUPT}").isNotNull())


def _given(text: Column) -> Column:
    return F.coalesce(~F.trim(text).isin("", "{}", "[]", "null"), F.lit(False))


def message_rows(parsed: DataFrame) -> DataFrame:
    """Good messages as scoring rows; absent fields take the message defaults."""
    features = F.get_json_object("value", "$.features")
    graph = F.get_json_object("value", "$.callGraph")
    good = parsed.where(~F.col("bad"))
    return good.select(
        F.coalesce("m.traceId", F.lit("unknown")).alias("trace_id"),
        F.coalesce("m.sourceIp", F.lit("")).alias("source_ip"),
        F.coalesce("m.timestamp", F.lit(0)).alias("timestamp"),
        "m.features.*",
        F.coalesce("m.callGraph", F.array().cast(MESSAGE["callGraph"].dataType))
        .alias("call_graph"),
        _given(features).alias("has_features"),
        F.coalesce(features, F.lit("{}")).alias("features_json"),
        F.coalesce(graph, F.lit("[]")).alias("call_graph_json"),
    )


def split_bad_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scoring rows, texts that do not parse)."""
    parsed = parse_messages(messages)
    return message_rows(parsed), parsed.where("bad").select("value")
