"""Stored verdicts and tasks: filters, pages, counts, upserts and task reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import PART_ROWS, in_order

# Look-back of the time presets in milliseconds; a month is 30 days.
PRESETS_MS = {
    "1h": 3_600_000,
    "1d": 86_400_000,
    "1w": 604_800_000,
    "1m": 2_592_000_000,
}
DEEP_PAGE = 100_000
REPORT_LIMIT = 100


def contains(col: Column, text: str) -> Column:
    """Case-insensitive search for a literal substring."""
    return F.contains(F.lower(col), F.lower(F.lit(text)))


def _all(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def filter_results(
    df: DataFrame, trace_id=None, source_ip=None, is_anomaly=None, detect_type=None,
    min_prob=None, max_prob=None, start_time=None, end_time=None, file_id=None, task_name=None,
) -> DataFrame:
    """One predicate per given argument; blank texts are ignored, ranges are inclusive."""
    texts = {"trace_id": trace_id, "source_ip": source_ip, "task_name": task_name}
    equal = {"is_anomaly": is_anomaly, "detect_type": detect_type, "file_id": file_id}
    low = {"final_prob": min_prob, "timestamp": start_time}
    high = {"final_prob": max_prob, "timestamp": end_time}
    wanted = [contains(F.col(n), v) for n, v in texts.items() if v is not None and v.strip()]
    wanted += [F.col(n) == v for n, v in equal.items() if v is not None]
    wanted += [F.col(n) >= v for n, v in low.items() if v is not None]
    wanted += [F.col(n) <= v for n, v in high.items() if v is not None]
    return df.where(_all(wanted)) if wanted else df


def filter_tasks(
    df: DataFrame, name=None, status=None, start_date=None, end_date=None
) -> DataFrame:
    wanted = []
    if name and name.strip():
        wanted.append(contains(F.col("task_name"), name))
    if status and status.strip():
        wanted.append(F.col("status") == status)
    if start_date and start_date.strip():
        wanted.append(F.col("create_time") >= F.to_timestamp(F.lit(f"{start_date} 00:00:00")))
    if end_date and end_date.strip():
        wanted.append(F.col("create_time") <= F.to_timestamp(F.lit(f"{end_date} 23:59:59")))
    return df.where(_all(wanted)) if wanted else df


def time_range(
    df: DataFrame, preset: str = "all", now: int | None = None,
    start: int | None = None, end: int | None = None, ts: str = "timestamp",
) -> DataFrame:
    """Presets look back from ``now`` (ms) without an upper end; ``custom`` is inclusive."""
    if preset == "all":
        return df
    if preset == "custom":
        return df if start is None or end is None else df.where(F.col(ts).between(start, end))
    return df.where(F.col(ts) >= now - PRESETS_MS[preset])


def page(
    df: DataFrame, newest: str, tie: str, current: int = 1, size: int = 10,
    deep: int = DEEP_PAGE,
) -> DataFrame:
    """One page, newest first, NULL times last, ties by ``tie``.

    Early pages are a top-k. A top-k of a very deep page would carry all skipped rows to
    one task, so those pages number the rows in slices and filter the numbers instead.
    """
    skip = (current - 1) * size
    if skip + size <= deep:
        ordered = df.orderBy(F.desc(newest), F.asc(tie))
        return (ordered.offset(skip) if skip else ordered).limit(size)
    rank = df.withColumn("_age", F.coalesce(-F.col(newest).cast("double"), F.lit(float("inf"))))
    numbered = in_order(rank, [], ["_age", tie], index="_row")
    return numbered.where(F.col("_row").between(skip, skip + size - 1)).drop("_row", "_age")


def results_page(df: DataFrame, current: int = 1, size: int = 10, **filters) -> DataFrame:
    return page(filter_results(df, **filters), "timestamp", "id", current, size)


def tasks_page(df: DataFrame, current: int = 1, size: int = 10, **filters) -> DataFrame:
    return page(filter_tasks(df, **filters), "create_time", "id", current, size)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def latest_records(df: DataFrame, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.asc("id")).limit(n)


def detection_statistics(df: DataFrame, start=None, end=None) -> DataFrame:
    """Normal, anomaly and total counts; rows with any other flag are not in the total."""
    rows = filter_results(df, start_time=start, end_time=end)
    counts = rows.agg(
        F.count(F.when(F.col("is_anomaly") == 0, 1)).alias("normal"),
        F.count(F.when(F.col("is_anomaly") == 1, 1)).alias("anomaly"),
    )
    return counts.withColumn("total", F.col("normal") + F.col("anomaly"))


def latest_by_trace(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Newest row per trace. A grouped maximum: partial results combine before the
    shuffle, so a trace with very many versions does not fill one task."""
    names = [n for n in df.columns if n != "trace_id"]
    newest = df.groupBy("trace_id").agg(F.max_by(F.struct(*names), F.col(arrival)).alias("_r"))
    return newest.select("trace_id", "_r.*").select(*df.columns)


def first_by_id(df: DataFrame, order: list[str], key: str = "_id") -> DataFrame:
    """First row per id in file order, with the number of rows the id has."""
    names = [n for n in df.columns if n != key and n not in order]
    first = df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), F.struct(*order)).alias("_r"),
        F.count(F.lit(1)).alias("copies"),
    )
    return first.select(key, "_r.*", "copies")


def upsert_by_trace(old: DataFrame, new: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Replace known traces by their newest row, keeping the stored id; insert the rest.

    One grouped pass over both tables: the newest row wins and the oldest id stays.
    """
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    when = F.struct("_gen", arrival)
    names = [n for n in old.columns if n not in ("trace_id", "id")]
    merged = both.groupBy("trace_id").agg(
        F.max_by(F.struct(*names), when).alias("_r"), F.min_by("id", when).alias("id")
    )
    return merged.select("trace_id", "id", "_r.*").select(*old.columns)


def tag_with_task(records: DataFrame, tasks: DataFrame, task_key: str = "task_id") -> DataFrame:
    """Add file id, task name and detect type 1; records of unknown tasks drop out.

    The task list is joined without a hint: the planner broadcasts it while it is small.
    """
    known = tasks.select(F.col("id").alias(task_key), "task_name")
    return records.join(known, task_key).withColumns(
        {"file_id": F.col(task_key), "detect_type": F.lit(1)}
    )


def sequence_timestamps(
    records: DataFrame, now: int, order: list[str], task_key: str = "task_id",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The i-th record of a task gets ``now + i`` milliseconds."""
    out = in_order(records, [task_key], order, index="_i", part_rows=part_rows)
    return out.withColumn("timestamp", F.lit(now).cast("long") + F.col("_i")).drop("_i")


def task_summary(
    scored: DataFrame, skipped: DataFrame, tasks: DataFrame, task_key: str = "task_id"
) -> DataFrame:
    """Counts and anomaly rate per task; a task without rows keeps zero counts.

    ``duration`` (ms) is added if the tasks carry start and end times. Tasks with a status,
    such as FAILED, keep it; all others are COMPLETED.
    """
    s = scored.select(task_key, F.lit(1).alias("r"), F.col("is_anomaly").alias("a"),
                      F.lit(0).alias("k"))
    k = skipped.select(task_key, F.lit(0).alias("r"), F.lit(0).alias("a"), F.lit(1).alias("k"))
    counts = s.unionByName(k).groupBy(task_key).agg(
        F.sum("r").alias("record_count"),
        F.count(F.when((F.col("r") == 1) & (F.col("a") == 1), 1)).alias("anomaly_count"),
        F.sum("k").alias("skipped_count"),
    )
    out = tasks.join(counts, task_key, "left").fillna(
        0, ["record_count", "anomaly_count", "skipped_count"]
    )
    rate = F.when(
        F.col("record_count") > 0, F.col("anomaly_count") / F.col("record_count")
    ).otherwise(F.lit(0.0))
    out = out.withColumn("anomaly_rate", rate)
    if "start_time" in tasks.columns and "end_time" in tasks.columns:
        spent = F.unix_millis("end_time") - F.unix_millis("start_time")
        out = out.withColumn("duration", spent)
    if "status" not in tasks.columns:
        out = out.withColumn("status", F.lit("COMPLETED"))
    return out


def skipped_rows(validated: DataFrame, key: str = "_id") -> DataFrame:
    """All rows that fail validation, with the reason."""
    return validated.where(~F.col("is_valid")).select(
        F.col(key).alias("id"), F.col("error").alias("reason")
    )


def skipped_report(validated: DataFrame, n: int = REPORT_LIMIT, key: str = "_id") -> DataFrame:
    """First rows of ``skipped_rows`` by id: the part that goes into a task report."""
    return skipped_rows(validated, key).orderBy("id", "reason").limit(n)


def latest_score(df: DataFrame) -> DataFrame:
    return df.agg(
        F.max_by("final_prob", F.struct("timestamp", "id")).alias("final_prob")
    )


def live_counters(df: DataFrame, now: int | None = None, start=None, end=None) -> DataFrame:
    """Total and anomaly counters of arriving rows.

    Rows before ``start`` are not counted; nothing is counted live when the shown range
    ended more than 60 s ago. ``now`` is in ms; without it the time of the query, and in a
    stream that of each micro-batch, is taken.
    """
    rows = df.where(F.col("timestamp") >= start) if start is not None else df
    if end is not None:
        clock = F.unix_millis(F.current_timestamp()) if now is None else F.lit(now)
        rows = rows.where(F.lit(end) >= clock - 60_000)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("is_anomaly") == 1, 1)).alias("anomaly"),
    )


def per_second_rates(df: DataFrame) -> DataFrame:
    """Verdicts and anomalies per second; batch and streaming (``event_time`` column)."""
    return df.groupBy(F.window("event_time", "1 second").alias("w")).agg(
        F.count(F.lit(1)).alias("qps"),
        F.count(F.when(F.col("is_anomaly") == 1, 1)).alias("anomalies"),
    ).select(F.col("w.start").alias("second"), "qps", "anomalies")


def rate_series(rates: DataFrame, now: str, seconds: int = 60) -> DataFrame:
    """The last ``seconds`` seconds before ``now``; seconds without rows count 0."""
    spark = rates.sparkSession
    axis = spark.range(seconds, 0, -1).select(
        (F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.col("id"))).alias("second")
    )
    recent = rates.where(
        (F.col("second") < F.to_timestamp(F.lit(now)))
        & (F.col("second")
           >= F.to_timestamp(F.lit(now)) - F.make_dt_interval(secs=F.lit(seconds)))
    )
    return axis.join(recent, "second", "left").fillna(0, ["qps", "anomalies"])


def explain_lifecycle(events: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """State of each explanation request after all its events.

    ``events``: trace_id, ord, kind (request | result | error), payload. A request makes
    the record pending (0) and starts a job unless one is pending; a result makes it done
    (1) with its payload, an error failed (2); both are ignored before the first request.
    """
    first = events.where(F.col("kind") == "request").groupBy("trace_id").agg(
        F.min("ord").alias("_first")
    )
    seen = events.join(first, "trace_id").where(F.col("ord") >= F.col("_first"))
    seen = in_order(seen, ["trace_id"], ["ord"], previous={"_before": "kind"},
                    part_rows=part_rows)
    starts = (F.col("kind") == "request") & F.coalesce(F.col("_before") != "request", F.lit(True))
    done = F.when(F.col("kind") == "result", F.col("ord"))
    return seen.groupBy("trace_id").agg(
        F.max_by(status_code(F.col("kind")), "ord").alias("status"),
        F.max_by("payload", done).alias("payload"),
        F.count(F.when(starts, 1)).alias("jobs"),
    )


def status_code(kind: Column) -> Column:
    return F.when(kind == "request", 0).when(kind == "result", 1).otherwise(2)
