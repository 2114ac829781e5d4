"""Whole detection jobs: file tasks and captures, each one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.fusion import fuse_with_fallback
from ..functions.http import decode_payload, request_path
from ..functions.records import (
    clean_features, features_to_json, graph_to_json, source_ip, task_trace_id, validate_features,
)
from ..operators import graphs as g, sessions as s
from ..operators.forest import ForestScorer
from ..operators.gcn import TASK_EDGES, score_call_graphs, score_edges
from ..operators.graph_batch import Weights
from ..operators.joins import pair_features_graphs
from ..operators.lineage import checkpointed
from ..operators.ordering import PART_ROWS
from ..operators.results import (
    REPORT_LIMIT, sequence_timestamps, tag_with_task, task_summary,
)
from ..schemas import CATEGORICAL, MODEL_INPUT, NUMERIC, TOPOLOGY, c
from ..sources.captures import capture_errors, good_packets
from ..sources.verdicts import VerdictStore


@dataclass
class Models:
    forest: ForestScorer
    gcn: Weights  # two layers, for records with features
    fallback: Weights  # one layer, for records without


def infer(rows: DataFrame, models: Models, mode: str = "adaptive") -> DataFrame:
    """Score and fuse rows with feature columns, ``call_graph`` and ``has_features``.

    Map-only: no shuffle, and the same code on batches and streams.
    """
    rows = rows.withColumn("has_graph", F.coalesce(F.size("call_graph") > 0, F.lit(False)))
    scored = models.forest(rows)
    scored = score_call_graphs(scored, models.gcn, fallback=models.fallback)
    return fuse_with_fallback(scored, mode)


def detect_batch(
    features: DataFrame | None, graphs: DataFrame | None, models: Models, task: int,
    allow_graph_only: bool = False, mode: str = "adaptive",
) -> tuple[DataFrame, DataFrame]:
    """A file task: (scored records, skipped rows).

    ``features``: one row per ``_id`` with ``copies`` (see ``first_by_id``); ``graphs``: one
    row per ``_id``. Records that fail validation are skipped with their reason; a task
    without features skips every record unless ``allow_graph_only``.
    """
    paired = pair_features_graphs(features, graphs)
    if features is None:
        missing = {n: F.lit(None).cast("double") for n in NUMERIC}
        missing |= {n: F.lit(None).cast("string") for n in CATEGORICAL}
        paired = paired.withColumns(missing)
    checked = validate_features(paired)
    if features is None and allow_graph_only:
        checked = checked.withColumns({"is_valid": F.lit(True), "error": F.lit(None)})
    elif features is None:
        checked = checked.withColumn("error", F.lit(f"missing numeric feature: {NUMERIC[0]}"))
    skipped = checked.where(~F.col("is_valid")).select(
        F.col("_id").alias("id"), F.col("error").alias("reason")
    )
    own = [n for n in (features.columns if features is not None else []) if n != "copies"]
    texts = checked.where("is_valid").withColumns({
        "has_features": F.lit(features is not None),
        "features_json": features_to_json(own),
        "call_graph_json": graph_to_json(F.col("call_graph")),
        "source_ip": source_ip(checked),
    })
    scored = infer(clean_features(texts), models, mode)
    return scored.select(
        task_trace_id("file", task, F.col("_id")).alias("trace_id"),
        "source_ip", "rf_prob", "gcn_prob", "final_prob", "is_anomaly", "mode", "threshold",
        "features_json", "call_graph_json",
    ), skipped


def detect_records(
    records: DataFrame, models: Models, edges: DataFrame | None = None, mode: str = "adaptive",
) -> tuple[DataFrame, DataFrame]:
    """A batch request: (scored records, skipped records with their reason).

    Every record decides for itself what it has. ``records``: trace_id, feature columns (NULL
    where a record has none; columns may lack), and if known source_ip and ``has_features``;
    without that flag a record has features if one of the model's inputs is there. Graphs are
    arrays in ``call_graph``, or, whatever their size, an edge table ``edges`` (trace_id, pos,
    from_id, to_id). A record whose features do not validate is skipped alone; one without
    features is scored by its graph, one without a graph by its features.
    """
    missing = {n: F.lit(None).cast("double") for n in NUMERIC if n not in records.columns}
    missing |= {n: F.lit(None).cast("string") for n in CATEGORICAL if n not in records.columns}
    rows = records.withColumns(missing)
    if "has_features" not in rows.columns:
        rows = rows.withColumn("has_features", F.coalesce(*[c(n).cast("string") for n in MODEL_INPUT]).isNotNull())
    if "source_ip" not in rows.columns:
        rows = rows.withColumn("source_ip", F.lit(""))
    checked = validate_features(rows)
    bad = F.col("has_features") & ~F.col("is_valid")
    skipped = checked.where(bad).select(F.col("trace_id").alias("id"), F.col("error").alias("reason"))
    own = [n for n in MODEL_INPUT + TOPOLOGY if n in rows.columns]
    good = clean_features(checked.where(~bad).withColumn(
        "features_json", F.when(F.col("has_features"), features_to_json(own))))
    if edges is None:
        scored = infer(good.withColumn("call_graph_json", graph_to_json(F.col("call_graph"))), models, mode)
    else:
        asked = good.select("trace_id", "has_features").distinct()
        of = checkpointed(edges.join(asked, "trace_id"))
        rich, poor = (of.where(x).drop("has_features") for x in ("has_features", "NOT has_features"))
        probability = score_edges(rich, models.gcn).unionByName(score_edges(poor, models.fallback))
        joined = models.forest(good).join(probability, "trace_id", "left").withColumns({
            "has_graph": F.col("gcn_prob").isNotNull(),
            "gcn_prob": F.coalesce("gcn_prob", F.lit(0.0)),
            "call_graph_json": F.lit(None).cast("string"),
        })
        scored = fuse_with_fallback(joined, mode)
    return scored.select(
        "trace_id", "source_ip", "rf_prob", "gcn_prob", "final_prob", "is_anomaly", "mode", "threshold",
        "features_json", "call_graph_json",
    ), skipped


def task_report(scored: DataFrame, skipped: DataFrame, task: DataFrame) -> tuple:
    """(summary row, first skipped rows) of a file task. ``task``: one row with ``task_id``
    and, if known, ``start_time`` and ``end_time``."""
    key = task.select("task_id").scalar()
    marked = [df.withColumn("task_id", key) for df in (scored, skipped)]
    return task_summary(*marked, task), skipped.orderBy("id", "reason").limit(REPORT_LIMIT)


def store_task(scored: DataFrame, tasks: DataFrame, task: int, now: int, path: str) -> bool:
    """Add the records of a file or capture task to the verdict table at ``path``, with its
    name and time stamps. A task that is there already, or is not known, changes nothing."""
    named = tag_with_task(scored.withColumn("task_id", F.lit(task).cast("long")), tasks)
    stamped = sequence_timestamps(named, now, ["trace_id"]).drop("task_id")
    return VerdictStore(scored.sparkSession, path).append(stamped, f"task:{task}")


def capture_tables(packets: DataFrame, part_rows: int = PART_ROWS):
    """Sessions, requests and edges of decoded packets.

    Payloads are parsed once: what the features need, addresses, times and paths, is
    written to the checkpoint folder, and all later passes read that slim table.
    """
    path = request_path(decode_payload(F.col("payload")))
    slim = checkpointed(packets.select(
        "trace_id", "file_name", "pkt_no", "ts", "src_ip", "dst_ip", "src_port", "dst_port",
        path.alias("path"),
    ))
    requests = slim.where(F.col("path").isNotNull()).select("trace_id", "pkt_no", "ts", "path")
    return s.capture_sessions(slim), requests, g.call_edges(requests, part_rows=part_rows)


def detect_captures(
    packets: DataFrame, models: Models, task: int, mode: str = "adaptive",
    part_rows: int = PART_ROWS, text_edges: int = TASK_EDGES,
) -> DataFrame:
    """A capture task: one verdict per capture. Captures are never gathered: features are
    grouped sums, graphs stay edge tables, and scores meet by trace id. The graph of a capture
    is also given as text, as the record format has it; one of more than ``text_edges`` edges
    fits no record, its text is NULL and ``capture_tables`` has its edges."""
    sessions, requests, edges = capture_tables(packets, part_rows)
    features = s.session_features(sessions, requests, g.topology_features(edges))
    rows = models.forest(features.withColumn("has_features", F.lit(True)))
    gcn = score_edges(edges, models.gcn)
    joined = rows.join(gcn.withColumnRenamed("trace_id", "_id"), "_id", "left").withColumns({
        "has_graph": F.col("gcn_prob").isNotNull(),
        "gcn_prob": F.coalesce("gcn_prob", F.lit(0.0)),
        "features_json": features_to_json(MODEL_INPUT + TOPOLOGY),
    })
    sizes = edges.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))
    short = edges.join(sizes.where(F.col("n") <= text_edges).select("trace_id"), "trace_id", "left_semi")
    texts = g.collect_graphs(short).select("_id", graph_to_json(F.col("call_graph")).alias("call_graph_json"))
    fused = fuse_with_fallback(joined.join(texts, "_id", "left"), mode)
    return fused.select(
        task_trace_id("pcap", task, F.col("_id")).alias("trace_id"), c("source_ip"),
        "rf_prob", "gcn_prob", "final_prob", "is_anomaly", "mode", "threshold", "features_json",
        "call_graph_json",
    )


def detect_capture_task(
    decoded: DataFrame, models: Models, task: DataFrame, mode: str = "adaptive",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole capture task: (verdicts, summary row, files that could not be read).

    ``decoded``: packet rows with the errors of broken files (``read_packets``). ``task``: one
    row with ``task_id`` and, if known, ``start_time`` and ``end_time``. The summary has the
    counts, the anomaly rate, the duration and the status of the task, as that of a file task;
    broken files count as skipped.
    """
    decoded = checkpointed(decoded)
    broken = capture_errors(decoded).select(F.col("file_name").alias("id"), F.col("error").alias("reason"))
    number = task.select("task_id").first()["task_id"]
    scored = checkpointed(detect_captures(good_packets(decoded), models, number, mode))
    summary, report = task_report(scored, broken, task)
    return scored, summary, report
