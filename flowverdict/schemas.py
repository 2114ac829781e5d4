"""Column names and Spark schemas of the data model.

Every table that enters the package has an explicit schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

# The model input order is these seven numbers, then the two categories.
NUMERIC = [
    "inter_api_access_duration(sec)",
    "api_access_uniqueness",
    "sequence_length(count)",
    "vsession_duration(min)",
    "num_sessions",
    "num_users",
    "num_unique_apis",
]
CATEGORICAL = ["ip_type", "source"]
MODEL_INPUT = NUMERIC + CATEGORICAL
TOPOLOGY = ["graph_density", "max_in_degree", "avg_clustering"]

# Columns that training files carry and scoring drops.
TRAINING_ONLY = ["behavior", "behavior_type", "classification"]
SOURCE_IP_NAMES = ["source_ip", "src_ip", "sourceIp"]


def _fields(names, kind):
    return [T.StructField(n, kind, True) for n in names]


FEATURES = T.StructType(
    _fields(["_id"], T.StringType())
    + _fields(NUMERIC, T.DoubleType())
    + _fields(CATEGORICAL, T.StringType())
    + _fields(TOPOLOGY, T.DoubleType())
)

EDGE = T.StructType(_fields(["fromId", "toId"], T.StringType()))
CALL_GRAPH = T.ArrayType(EDGE, True)
GRAPH_FILE = T.StructType(
    [T.StructField("_id", T.StringType(), True), T.StructField("call_graph", CALL_GRAPH, True)]
)

PACKETS = T.StructType(
    [
        T.StructField("trace_id", T.StringType(), True),
        T.StructField("file_name", T.StringType(), True),
        T.StructField("pkt_no", T.LongType(), True),
        T.StructField("ts", T.DoubleType(), True),
        T.StructField("src_ip", T.StringType(), True),
        T.StructField("dst_ip", T.StringType(), True),
        T.StructField("src_port", T.IntegerType(), True),
        T.StructField("dst_port", T.IntegerType(), True),
        T.StructField("payload", T.BinaryType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

MESSAGE_FEATURES = T.StructType(
    _fields(NUMERIC, T.DoubleType())
    + _fields(CATEGORICAL, T.StringType())
    + _fields(TOPOLOGY, T.DoubleType())
)

MESSAGE = T.StructType(
    [
        T.StructField("traceId", T.StringType(), True),
        T.StructField("sourceIp", T.StringType(), True),
        T.StructField("timestamp", T.LongType(), True),
        T.StructField("features", MESSAGE_FEATURES, True),
        T.StructField("callGraph", CALL_GRAPH, True),
    ]
)

# The stored verdicts of streams (detect type 0), file and capture tasks (1).
VERDICT = T.StructType(
    [T.StructField("id", T.LongType(), True)]
    + _fields(["trace_id", "source_ip"], T.StringType())
    + _fields(["timestamp"], T.LongType())
    + _fields(["rf_prob", "gcn_prob", "final_prob"], T.DoubleType())
    + _fields(["is_anomaly"], T.IntegerType())
    + _fields(["mode"], T.StringType())
    + _fields(["threshold", "weight_rf"], T.DoubleType())
    + _fields(["features_json", "call_graph_json"], T.StringType())
    + _fields(["detect_type"], T.IntegerType())
    + _fields(["file_id"], T.LongType())
    + _fields(["task_name"], T.StringType())
)

WEIGHTS = T.MapType(T.StringType(), T.DoubleType())
ABNORMAL_EDGES = T.ArrayType(
    T.StructType(
        _fields(["fromId", "toId"], T.StringType())
        + [T.StructField("importance", T.DoubleType(), True)]
    )
)


def c(name: str):
    """Column of a literal name; feature names hold parentheses, so quote them."""
    return F.col(f"`{name}`")
