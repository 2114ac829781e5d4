"""Capture sessions, ordered requests and the feature record of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.http import capture_name_parts, ip_type, service_name
from ..schemas import TOPOLOGY
from .ordering import PART_ROWS, in_order


def capture_sessions(packets: DataFrame) -> DataFrame:
    """One row per capture: endpoints, time range and packet count.

    Endpoints come from the file name if it parses, else from the first packet that
    has an address and the first that has ports, taken separately.
    """

    def first(col):
        return F.min_by(col, F.when(F.col(col).isNotNull(), F.col("pkt_no"))).alias(col)

    grouped = packets.groupBy("trace_id").agg(
        F.min("file_name").alias("file_name"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"),
        first("src_ip"), first("dst_ip"), first("src_port"), first("dst_port"),
    )
    name = F.col("_name")
    named = name["source_ip"].isNotNull()

    def pick(part, packet, default):
        value = F.when(named, name[part]).otherwise(F.col(packet))
        return F.coalesce(value, F.lit(default))

    return grouped.withColumn("_name", capture_name_parts(F.col("file_name"))).select(
        "trace_id",
        "file_name",
        pick("source_ip", "src_ip", "unknown").alias("source_ip"),
        pick("source_port", "src_port", 0).alias("source_port"),
        pick("dest_ip", "dst_ip", "unknown").alias("dest_ip"),
        pick("dest_port", "dst_port", 0).alias("dest_port"),
        "start_time",
        "end_time",
        "packet_count",
    )


def duration_seconds(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start).otherwise(F.lit(0.0))


def order_requests(requests: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Requests with ``seq``: by time inside a capture, ties in packet order."""
    return in_order(requests, ["trace_id"], ["ts", "pkt_no"], index="seq", part_rows=part_rows)


def request_gaps(requests: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Seconds since the previous request of the capture; NULL for the first."""
    out = in_order(
        requests, ["trace_id"], ["ts", "pkt_no"], index="seq",
        previous={"_previous_ts": "ts"}, part_rows=part_rows,
    )
    return out.withColumn("gap", F.col("ts") - F.col("_previous_ts")).drop("_previous_ts")


def request_measures(requests: DataFrame) -> DataFrame:
    """Mean gap, uniqueness, length and distinct paths per capture.

    In time order every gap is >= 0 and the gaps add up to last minus first, so the
    mean needs no window. Paths are counted first per (capture, path), which spreads a
    large capture over many tasks before its few totals meet.
    """
    per_path = requests.groupBy("trace_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    totals = per_path.groupBy("trace_id").agg(
        F.sum("n").alias("requests"),
        F.count("path").alias("paths"),
        (F.max("hi") - F.min("lo")).alias("span"),
    )
    return totals.select(
        "trace_id",
        F.when(F.col("requests") > 1, F.col("span") / (F.col("requests") - 1))
        .otherwise(F.lit(0.0)).alias("mean_gap"),
        (F.col("paths") / F.col("requests")).alias("uniqueness"),
        F.col("requests").cast("double").alias("sequence_length"),
        F.col("paths").cast("double").alias("unique_apis"),
    )


def session_features(
    sessions: DataFrame, requests: DataFrame, topology: DataFrame | None = None
) -> DataFrame:
    """Feature record of every session; sessions without requests get the empty record."""
    out = sessions.join(request_measures(requests), "trace_id", "left")
    if topology is None:
        out = out.withColumns({n: F.lit(0.0) for n in TOPOLOGY})
    else:
        out = out.join(topology.select("trace_id", *TOPOLOGY), "trace_id", "left")
    zero = F.lit(0.0)
    minutes = duration_seconds(F.col("start_time"), F.col("end_time")) / 60.0
    return out.select(
        F.col("trace_id").alias("_id"),
        F.coalesce("mean_gap", zero).alias("inter_api_access_duration(sec)"),
        F.coalesce("uniqueness", zero).alias("api_access_uniqueness"),
        F.coalesce("sequence_length", zero).alias("sequence_length(count)"),
        F.when(F.col("sequence_length").isNotNull(), minutes).otherwise(zero)
        .alias("vsession_duration(min)"),
        ip_type(F.col("source_ip")).alias("ip_type"),
        F.lit(1.0).alias("num_sessions"),
        F.lit(1.0).alias("num_users"),
        F.coalesce("unique_apis", zero).alias("num_unique_apis"),
        F.lit("E").alias("source"),
        *[F.coalesce(n, zero).alias(n) for n in TOPOLOGY],
        F.col("source_ip"),
    )


def service_catalog(requests: DataFrame) -> DataFrame:
    """Distinct paths per service with the position they were first seen at."""
    return requests.groupBy(
        "trace_id", service_name(F.col("path")).alias("service"), "path"
    ).agg(F.min("seq").alias("first_seq"))
