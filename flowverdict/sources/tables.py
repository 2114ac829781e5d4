"""The data model's tables, derived from the warehouse tables at a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fusion as fu


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ts(col: str = "ts") -> Column:
    """Time without zone to an instant; the session runs in UTC."""
    return F.col(col).cast("timestamp")


def user_ip(user: Column) -> Column:
    """An address per user that covers all branches of the address rule."""
    low = (user % 250).cast("string")
    return (
        F.when(user % 5 == 0, F.concat(F.lit("127.0.0."), low))
        .when(user % 5 == 1, F.concat(F.lit("192.168.1."), low))
        .when(user % 5 == 2, F.concat(F.lit("10.1.2."), low))
        .when(user % 5 == 3,
              F.concat(F.lit("172."), (16 + user % 20).cast("string"), F.lit(".0.1")))
        .otherwise(F.concat(F.lit("8.8.8."), low))
    )


def session_id(user: Column, ts: Column) -> Column:
    """A session is one user and one week."""
    return F.concat(
        user.cast("string"), F.lit("-"), F.date_format(F.date_trunc("week", ts), "yyyyMMdd")
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Events as packets: one packet per event, without payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        session_id(F.col("user_id"), _ts()).alias("trace_id"),
        F.lit(None).cast("string").alias("file_name"),
        F.col("event_id").alias("pkt_no"),
        (F.unix_micros(_ts()) / 1e6).alias("ts"),
        user_ip(F.col("user_id")).alias("src_ip"),
        F.lit("10.0.0.1").alias("dst_ip"),
        (40000 + F.col("user_id") % 1000).cast("int").alias("src_port"),
        F.lit(8080).alias("dst_port"),
        F.concat(
            F.lit("/"), F.col("event_type"), F.lit("/v1/"), (k % 10).cast("string")
        ).alias("path"),
        "event_type",
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return packets(spark, folder).select("trace_id", "pkt_no", "ts", "path")


def score_columns(event_id: Column) -> dict[str, Column]:
    return {
        "rf_prob": (event_id * 31 % 997) / F.lit(997.0),
        "gcn_prob": (event_id * 7919 % 1009) / F.lit(1009.0),
    }


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Two probabilities and a truth per event."""
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("trace_id"),
        *[v.alias(k) for k, v in score_columns(F.col("event_id")).items()],
        (F.col("event_type") == "error").cast("int").alias("y"),
        "event_type",
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Stored verdicts: one per event, fused with the production parameters."""
    event, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, folder, "events").select(
        event.alias("id"),
        F.concat(F.lit("evt-"), event.cast("string")).alias("trace_id"),
        session_id(user, _ts()).alias("session"),
        user_ip(user).alias("source_ip"),
        F.floor(F.unix_micros(_ts()) / 1000).alias("timestamp"),
        *[v.alias(k) for k, v in score_columns(event).items()],
        (event % 2).cast("int").alias("detect_type"),
        F.when(event % 2 == 1, event % 7).alias("file_id"),
        F.concat(F.lit("Task "), F.col("event_type")).alias("task_name"),
        _ts().alias("event_time"),
    )
    fused = fu.fuse(rows)
    return fused.withColumns(
        {"final_prob": F.col("fusion.prob"), "is_anomaly": F.col("fusion.verdict")}
    ).drop("fusion")


def raw_http(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as request packets, the page text as the body; every fifth page has a further
    packet with a blank body, whose number is below 0."""
    url = F.col("url")
    host = F.split_part(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    path = F.concat(
        F.lit("/"), F.regexp_extract(url, r"^[a-z]+://[^/]*/(.*)$", 1)
    )
    page = F.col("page_id")
    verb = (
        F.when(page % 7 == 0, "get").when(page % 7 == 1, "POST").when(page % 7 == 2, "CONNECT")
        .otherwise("GET")
    )
    text = F.concat(
        verb, F.lit(" "), path, F.lit(" HTTP/1.1\r\nHost: first.example\r\nhOST:  "), host,
        F.lit(" \r\n"),
        F.when(page % 2 == 0, F.lit("User-Agent: probe/1.0\r\n")).otherwise(F.lit("")),
        F.when(page % 3 == 0, F.lit("Content-Type: text/html\r\n")).otherwise(F.lit("")),
        F.lit("\r\n"),
        F.when(F.col("blank"), F.lit("  ")).otherwise(F.col("html")),
        F.lit("\r\n"),
    )
    pages = table(spark, folder, "pages").withColumn("blank", F.lit(False))
    further = pages.where(page % 5 == 0).withColumn("blank", F.lit(True))
    return pages.unionByName(further).select(
        host.alias("trace_id"),
        F.when(F.col("blank"), -1 - page).otherwise(page).alias("pkt_no"),
        page.cast("double").alias("ts"),
        text.alias("text"),
        F.encode(text, "UTF-8").alias("payload"),
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Batch "), F.col("o_orderpriority")).alias("task_name"),
        F.col("o_orderstatus").alias("status"),
        _ts("o_orderdate").alias("create_time"),
        F.col("o_custkey").alias("custkey"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as scaled feature vectors, label 0 against rest."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
        (F.col("label") == 0).cast("int").alias("y"),
    )


def dirty_features(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as feature rows with NULL, NaN and infinite values among them."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("_id"),
        F.when(key % 11 == 0, nan).otherwise(F.col("l_tax"))
        .alias("inter_api_access_duration(sec)"),
        F.when(key % 13 == 0, inf).otherwise(F.col("l_discount")).alias("api_access_uniqueness"),
        F.when(key % 17 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
        .alias("sequence_length(count)"),
        F.when(key % 19 == 0, -inf).otherwise(F.col("l_extendedprice"))
        .alias("vsession_duration(min)"),
        F.lit(1.0).alias("num_sessions"),
        F.lit(1.0).alias("num_users"),
        F.col("l_linenumber").cast("double").alias("num_unique_apis"),
        F.when(key % 23 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("ip_type"),
        F.col("l_linestatus").alias("source"),
    )
