"""Queries on packets, requests, sessions and call graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowverdict.functions import http, records
from flowverdict.operators import graphs as g, joins as j, results as r, sessions as s
from flowverdict.schemas import CATEGORICAL, NUMERIC, c
from flowverdict.sources import tables as t

from .registry import query, rounded
from .views import sql

FEATURE_SQL = """
    SELECT _id,
           round("inter_api_access_duration(sec)", 6) AS "inter_api_access_duration(sec)",
           round(api_access_uniqueness, 6) AS api_access_uniqueness,
           "sequence_length(count)",
           round("vsession_duration(min)", 6) AS "vsession_duration(min)",
           ip_type, num_sessions, num_users, num_unique_apis, source,
           round(graph_density, 6) AS graph_density, max_in_degree,
           round(avg_clustering, 6) AS avg_clustering, source_ip
    FROM features"""


def features(spark, folder):
    """Feature record of every session, topology included."""
    requests = t.requests(spark, folder)
    sessions = s.capture_sessions(t.packets(spark, folder))
    return s.session_features(sessions, requests, g.topology_features(g.call_edges(requests)))


@query("session_features", sql(FEATURE_SQL))
def session_features(spark, folder):
    return rounded(features(spark, folder))


@query("capture_sessions", sql("""
    SELECT trace_id, source_ip, source_port, dest_ip, dest_port, packet_count,
           round(start_time, 6) AS start_time, round(end_time, 6) AS end_time,
           round(CASE WHEN end_time > start_time THEN end_time - start_time ELSE 0.0 END, 5)
               AS duration_s
    FROM sessions"""))
def capture_sessions(spark, folder):
    out = s.capture_sessions(t.packets(spark, folder)).drop("file_name")
    seconds = s.duration_seconds(F.col("start_time"), F.col("end_time"))
    return rounded(out).withColumn("duration_s", F.round(seconds, 5))


@query("order_requests", sql("""
    SELECT trace_id, pkt_no, round(ts, 6) AS ts, path, seq FROM requests"""))
def order_requests(spark, folder):
    return rounded(s.order_requests(t.requests(spark, folder)))


@query("request_gaps", sql("""
    SELECT trace_id, pkt_no, seq,
           round(ts - lag(ts) OVER (PARTITION BY trace_id ORDER BY ts, pkt_no), 5) AS gap
    FROM requests"""))
def request_gaps(spark, folder):
    out = s.request_gaps(t.requests(spark, folder))
    return out.select("trace_id", "pkt_no", "seq", F.round("gap", 5).alias("gap"))


@query("request_measures", sql("""
    SELECT trace_id, round(mean_gap, 6) AS mean_gap, round(uniqueness, 6) AS uniqueness,
           sequence_length, unique_apis FROM measures"""))
def request_measures(spark, folder):
    return rounded(s.request_measures(t.requests(spark, folder)))


@query("empty_records", sql("""
    SELECT s.trace_id AS _id, coalesce(m.sequence_length, 0.0) AS sequence_length,
           CASE WHEN m.trace_id IS NULL THEN 0.0 ELSE round((end_time - start_time) / 60.0, 5)
           END AS minutes, i.ip_type, 1.0::DOUBLE AS num_sessions, 'E' AS source
    FROM sessions s JOIN ip_types i USING (trace_id)
    LEFT JOIN (SELECT trace_id, count(*)::DOUBLE AS sequence_length FROM packets
               WHERE event_type = 'error' GROUP BY 1) m USING (trace_id)"""))
def empty_records(spark, folder):
    """Only error events carry a request here: sessions without one get defaults."""
    packets = t.packets(spark, folder)
    errors = packets.where(F.col("event_type") == "error").select("trace_id", "path", "ts")
    out = s.session_features(s.capture_sessions(packets), errors)
    return out.select(
        "_id", c("sequence_length(count)").alias("sequence_length"),
        F.round(c("vsession_duration(min)"), 5).alias("minutes"), "ip_type", "num_sessions",
        "source",
    )


@query("call_edges", sql("SELECT trace_id, pos, from_id, to_id FROM edges"))
def call_edges(spark, folder):
    return g.call_edges(t.requests(spark, folder))


@query("call_edges_dedup", sql("""
    SELECT trace_id, min(pos) AS pos, from_id, to_id FROM edges
    GROUP BY trace_id, from_id, to_id"""))
def call_edges_dedup(spark, folder):
    return g.call_edges(t.requests(spark, folder), dedup=True)


@query("service_catalog", sql("""
    SELECT trace_id,
           coalesce(regexp_extract(path, '^/*([^/]+)', 1), 'unknown') AS service,
           path, min(seq) AS first_seq
    FROM requests GROUP BY 1, 2, 3"""))
def service_catalog(spark, folder):
    return s.service_catalog(s.order_requests(t.requests(spark, folder)))


@query("graph_statistics", sql("""
    SELECT s.trace_id,
           (SELECT count(*) FROM edges e WHERE e.trace_id = s.trace_id) AS edge_count,
           (SELECT count(*) FROM nodes n WHERE n.trace_id = s.trace_id) AS node_count,
           (SELECT count(DISTINCT from_id) FROM edges e WHERE e.trace_id = s.trace_id)
               AS unique_from,
           (SELECT count(DISTINCT to_id) FROM edges e WHERE e.trace_id = s.trace_id) AS unique_to
    FROM sessions s"""))
def graph_statistics(spark, folder):
    requests = t.requests(spark, folder)
    return g.graph_statistics(g.call_edges(requests), requests.select("trace_id").distinct())


@query("graph_nodes", sql("""
    SELECT trace_id, node_id,
           row_number() OVER (PARTITION BY trace_id ORDER BY node_id) - 1 AS node_index
    FROM nodes"""))
def graph_nodes(spark, folder):
    return g.graph_nodes(g.call_edges(t.requests(spark, folder)))


@query("all_nodes", sql("SELECT trace_id, node_id FROM nodes"))
def all_nodes(spark, folder):
    return g.all_nodes(g.call_edges(t.requests(spark, folder)))


@query("node_degrees", sql("""
    SELECT trace_id, node_id, out_degree, in_degree, (out_degree + in_degree)::DOUBLE AS x
    FROM degrees"""))
def node_degrees(spark, folder):
    return g.node_degrees(g.call_edges(t.requests(spark, folder)))


@query("topology_features", sql("""
    SELECT trace_id, round(graph_density, 6) AS graph_density, max_in_degree,
           round(avg_clustering, 6) AS avg_clustering FROM topology"""))
def topology_features(spark, folder):
    return rounded(g.topology_features(g.call_edges(t.requests(spark, folder))))


@query("gcn_propagate", sql("""
    SELECT n.trace_id, n.node_id,
           round(n.x / n.d + coalesce(sum(m.n * u.x / sqrt(u.d * n.d)), 0.0), 6) AS propagated
    FROM scaled n
    LEFT JOIN links m ON m.trace_id = n.trace_id AND m.to_id = n.node_id
    LEFT JOIN scaled u ON u.trace_id = m.trace_id AND u.node_id = m.from_id
    GROUP BY n.trace_id, n.node_id, n.x, n.d""",
    links="""SELECT trace_id, from_id, to_id, count(*) AS n FROM edges
             WHERE from_id <> to_id GROUP BY 1, 2, 3""",
    scaled="""SELECT g.trace_id, g.node_id, (out_degree + in_degree)::DOUBLE AS x,
                     1.0 + coalesce((SELECT sum(n) FROM links l WHERE l.trace_id = g.trace_id
                         AND l.to_id = g.node_id), 0) AS d FROM degrees g"""))
def gcn_propagate(spark, folder):
    edges = g.call_edges(t.requests(spark, folder))
    return rounded(g.gcn_propagate(g.node_degrees(edges), edges))


def _graph_rows(spark, folder):
    """Sessions with at least one edge, as rows with a call-graph array."""
    return g.collect_graphs(g.call_edges(t.requests(spark, folder)))


@query("label_graphs", sql("""
    SELECT trace_id AS _id, count(*) AS edges, any_value(y) AS y
    FROM edges JOIN (SELECT trace_id, max((event_type = 'error')::INTEGER) AS y
                     FROM packets GROUP BY 1) USING (trace_id)
    GROUP BY trace_id"""))
def label_graphs(spark, folder):
    labelled = t.packets(spark, folder).groupBy(F.col("trace_id").alias("_id")).agg(
        F.max((F.col("event_type") == "error").cast("int")).alias("y")
    )
    out = g.label_graphs(_graph_rows(spark, folder), labelled)
    return out.select("_id", F.size("call_graph").cast("long").alias("edges"), "y")


@query("first_by_id", sql("""
    SELECT trace_id AS _id, arg_min(path, pkt_no) AS path, count(*) AS copies
    FROM requests GROUP BY trace_id"""))
def first_by_id(spark, folder):
    rows = t.requests(spark, folder).select(F.col("trace_id").alias("_id"), "pkt_no", "path")
    return r.first_by_id(rows, ["pkt_no"])


@query("pair_features_graphs", sql("""
    SELECT f._id, f."sequence_length(count)" AS sequence_length, e.edges
    FROM features f JOIN (SELECT trace_id, count(*) AS edges FROM edges GROUP BY 1) e
    ON e.trace_id = f._id"""))
def pair_features_graphs(spark, folder):
    paired = j.pair_features_graphs(
        features(spark, folder).withColumn("copies", F.lit(1)), _graph_rows(spark, folder)
    )
    return paired.select(
        "_id", c("sequence_length(count)").alias("sequence_length"),
        F.size("call_graph").cast("long").alias("edges"),
    )


@query("pair_by_id", sql("""
    SELECT s.trace_id AS _id, s.packet_count,
           (SELECT count(*) FROM edges e WHERE e.trace_id = s.trace_id) AS edges
    FROM sessions s"""))
def pair_by_id(spark, folder):
    sessions = s.capture_sessions(t.packets(spark, folder))
    paired = j.pair_by_id(
        sessions.select(F.col("trace_id").alias("_id"), "packet_count"),
        _graph_rows(spark, folder),
    )
    return paired.withColumn("edges", F.size("call_graph").cast("long")).drop("call_graph")


@query("common_ids", sql("SELECT DISTINCT trace_id AS _id FROM edges"))
def common_ids(spark, folder):
    sessions = s.capture_sessions(t.packets(spark, folder))
    edges = g.call_edges(t.requests(spark, folder))
    return j.common_ids(
        sessions.select(F.col("trace_id").alias("_id")),
        edges.select(F.col("trace_id").alias("_id")),
    )


@query("request_messages", sql("""
    SELECT f._id AS trace_id, f.source_ip, f.source,
           f."sequence_length(count)" AS sequence_length,
           (SELECT count(*) FROM edges e WHERE e.trace_id = f._id) AS edges,
           (SELECT arg_min(from_id, pos) FROM edges e WHERE e.trace_id = f._id) AS first_node
    FROM features f"""))
def request_messages(spark, folder):
    """Messages are written as JSON text and read back here."""
    from flowverdict.schemas import MESSAGE

    messages = j.to_request_messages(
        features(spark, folder), _graph_rows(spark, folder),
        F.col("source_ip"), F.lit(0).cast("long"),
    )
    m = messages.select("trace_id", F.from_json("value", MESSAGE).alias("m"))
    return m.select(
        "trace_id", F.col("m.sourceIp").alias("source_ip"),
        F.col("m.features.source").alias("source"),
        F.col("m.features").getField("sequence_length(count)").alias("sequence_length"),
        F.size("m.callGraph").cast("long").alias("edges"),
        F.try_element_at("m.callGraph", F.lit(1))["fromId"].alias("first_node"),
    )


# --- HTTP text -----------------------------------------------------------------------


@query("http_requests", sql("""
    SELECT trace_id, pkt_no, method, path, host, user_agent, content_type, body
    FROM http_requests"""))
def http_requests(spark, folder):
    return http.http_requests(t.raw_http(spark, folder)).drop("ts")


@query("request_line", sql("""
    SELECT pkt_no, CASE WHEN verb IN ('GET', 'POST') THEN verb END AS method,
           CASE WHEN verb IN ('GET', 'POST') THEN path END AS path FROM raw_http"""))
def request_line(spark, folder):
    text = F.col("text")
    return t.raw_http(spark, folder).select(
        "pkt_no", http.request_method(text).alias("method"), http.request_path(text).alias("path")
    )


@query("headers", sql("""
    SELECT pkt_no, host,
           CASE WHEN page_id % 2 = 0 THEN 'probe/1.0' END AS user_agent,
           CASE WHEN page_id % 3 = 0 THEN 'text/html' END AS content_type
    FROM raw_http"""))
def headers(spark, folder):
    lines = http.header_lines(F.col("text"))
    return t.raw_http(spark, folder).select(
        "pkt_no", http.header(lines, "Host").alias("host"),
        http.header(lines, "User-Agent").alias("user_agent"),
        http.header(lines, "Content-Type").alias("content_type"),
    )


@query("body", sql("""
    SELECT pkt_no,
           CASE WHEN NOT blank
                THEN nullif(trim(html, E' \\t\\n\\r\\x0b\\x0c'), '') END AS body
    FROM raw_http"""))
def body(spark, folder):
    return t.raw_http(spark, folder).select("pkt_no", http.body(F.col("text")).alias("body"))


@query("decode_payload", sql("""
    SELECT page_id AS pkt_no, md5(html) AS utf8, length(html) AS chars,
           (SELECT sum(CASE WHEN ord(ch) < 128 THEN 1 WHEN ord(ch) < 2048 THEN 2
                            WHEN ord(ch) < 65536 THEN 3 ELSE 4 END)
            FROM (SELECT unnest(string_split(html, '')) AS ch))::BIGINT + 1 AS latin1_chars
    FROM pages"""))
def decode_payload(spark, folder):
    """The page as valid UTF-8, and with a stray byte in front, which makes it Latin-1."""
    good = F.encode("html", "UTF-8")
    return t.table(spark, folder, "pages").select(
        F.col("page_id").alias("pkt_no"),
        F.md5(F.encode(http.decode_payload(good), "UTF-8")).alias("utf8"),
        F.length(http.decode_payload(good)).cast("long").alias("chars"),
        F.length(http.decode_payload(F.concat(F.unhex(F.lit("FF")), good))).cast("long")
        .alias("latin1_chars"),
    )


@query("capture_names", sql("""
    SELECT pkt_no, CASE WHEN ok THEN src_ip END AS source_ip,
           CASE WHEN ok THEN src_port END AS source_port,
           CASE WHEN ok THEN dst_ip END AS dest_ip, CASE WHEN ok THEN 8080 END AS dest_port
    FROM (SELECT *, event_type NOT IN ('error', 'view') AS ok FROM packets)"""))
def capture_names(spark, folder):
    """Names of errors have no number as a port, names of views lack a part."""
    port = F.when(F.col("event_type") == "error", "x8080").otherwise("8080")
    tail = F.when(F.col("event_type") == "view", port).otherwise(
        F.concat_ws("_", "dst_ip", port)
    )
    name = F.concat(F.concat_ws("_", "src_ip", "src_port", tail), F.lit(".pcap"))
    parts = http.capture_name_parts(name)
    return t.packets(spark, folder).select("pkt_no", parts.alias("p")).select("pkt_no", "p.*")


@query("ip_types", sql("SELECT trace_id, source_ip, ip_type FROM ip_types"))
def ip_types(spark, folder):
    out = s.capture_sessions(t.packets(spark, folder))
    return out.select("trace_id", "source_ip", http.ip_type(F.col("source_ip")).alias("ip_type"))


@query("service_names", sql("""
    SELECT page_id AS pkt_no,
           CASE WHEN regexp_extract(path, '^/*([^/]+)', 1) = '' THEN 'unknown'
                ELSE regexp_extract(path, '^/*([^/]+)', 1) END AS service
    FROM raw_http WHERE NOT blank"""))
def service_names(spark, folder):
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1))
    return t.table(spark, folder, "pages").select(
        F.col("page_id").alias("pkt_no"), http.service_name(path).alias("service")
    )


# --- Records -------------------------------------------------------------------------

_ERROR_SQL = "CASE " + " ".join(
    f"WHEN n{i} IS NULL THEN 'feature {n} is NULL' WHEN isnan(n{i}) THEN 'feature {n} is NaN' "
    f"WHEN isinf(n{i}) THEN 'feature {n} is Inf'"
    for i, n in enumerate(NUMERIC, 1)
) + " ".join(
    f" WHEN {n} IS NULL THEN 'category {n} is not valid'" for n in CATEGORICAL
) + " END"


@query("validate_features", sql(f"""
    SELECT _id, error, error IS NULL AS is_valid FROM (SELECT _id, {_ERROR_SQL} AS error
    FROM dirty)"""))
def validate_features(spark, folder):
    out = records.validate_features(t.dirty_features(spark, folder))
    return out.select("_id", "error", "is_valid")


@query("clean_features", sql("SELECT _id, " + ", ".join(
    f'CASE WHEN n{i} IS NULL OR isnan(n{i}) OR isinf(n{i}) THEN 0.0 ELSE n{i} END AS "{n}"'
    for i, n in enumerate(NUMERIC, 1)
) + ", coalesce(ip_type, 'unknown') AS ip_type, coalesce(source, 'unknown') AS source FROM dirty"))
def clean_features(spark, folder):
    return records.clean_features(t.dirty_features(spark, folder))


@query("default_missing", sql("SELECT _id, " + ", ".join(
    f'coalesce(CASE WHEN isnan(n{i}) THEN 0.0 ELSE n{i} END, 0.0) AS "{n}"'
    for i, n in enumerate(NUMERIC[:4], 1)
) + ", " + ", ".join(f'0.0::DOUBLE AS "{n}"' for n in NUMERIC[4:])
    + ", coalesce(ip_type, 'unknown') AS ip_type, 'unknown' AS source FROM dirty"))
def default_missing(spark, folder):
    """Three numbers and a category are left out and come back as defaults."""
    return records.fill_missing(t.dirty_features(spark, folder).drop(*NUMERIC[4:], "source"))


@query("skipped_report", sql(f"""
    SELECT _id AS id, error AS reason FROM (SELECT _id, {_ERROR_SQL} AS error FROM dirty)
    WHERE error IS NOT NULL ORDER BY _id, error LIMIT 100"""))
def skipped_report(spark, folder):
    return r.skipped_report(records.validate_features(t.dirty_features(spark, folder)))


@query("task_summary", sql(f"""
    SELECT source AS task_id, count(*) FILTER (error IS NULL) AS record_count,
           count(*) FILTER (error IS NULL AND n3 > 25) AS anomaly_count,
           count(*) FILTER (error IS NOT NULL) AS skipped_count, 'COMPLETED' AS status,
           round(count(*) FILTER (error IS NULL AND n3 > 25)
                 / (count(*) FILTER (error IS NULL))::DOUBLE, 6) AS anomaly_rate
    FROM (SELECT *, {_ERROR_SQL} AS error FROM dirty) GROUP BY source"""))
def task_summary(spark, folder):
    """Tasks are the line states; a long quantity stands for an anomaly."""
    rows = records.validate_features(t.dirty_features(spark, folder)).withColumn(
        "task_id", F.col("source")
    )
    scored = rows.where("is_valid").withColumn(
        "is_anomaly", (c("sequence_length(count)") > 25).cast("int")
    )
    tasks = rows.select("task_id").distinct()
    return rounded(r.task_summary(scored, rows.where(~F.col("is_valid")), tasks))


@query("labels", sql("""
    SELECT doc_id, (quality = 0)::INTEGER AS y FROM labels"""))
def labels(spark, folder):
    kind = F.when(F.col("quality") == 0, "outlier").otherwise("normal")
    return t.table(spark, folder, "labels").select("doc_id", records.label(kind).alias("y"))


@query("source_ips", sql("""
    SELECT _id, source_ip AS from_source_ip, '' AS without FROM features"""))
def source_ips(spark, folder):
    rows = features(spark, folder)
    return rows.select(
        "_id", records.source_ip(rows).alias("from_source_ip"),
        records.source_ip(rows.drop("source_ip")).alias("without"),
    )


@query("trace_ids", sql("""
    SELECT o_orderkey, 'file-' || o_custkey || '-' || o_orderkey AS trace_id FROM orders"""))
def trace_ids(spark, folder):
    out = records.task_trace_id("file", F.col("o_custkey"), F.col("o_orderkey").cast("string"))
    return t.table(spark, folder, "orders").select("o_orderkey", out.alias("trace_id"))


@query("payload_json", sql("""
    SELECT f._id, f."sequence_length(count)" AS sequence_length, f.ip_type,
           (SELECT count(*) FROM edges e WHERE e.trace_id = f._id) AS edges,
           NOT EXISTS (SELECT 1 FROM edges e WHERE e.trace_id = f._id) AS no_graph_text
    FROM features f"""))
def payload_json(spark, folder):
    """Features and graph to JSON text and back."""
    rows = j.pair_by_id(features(spark, folder), _graph_rows(spark, folder))
    texts = rows.select(
        "_id",
        records.features_to_json(NUMERIC + CATEGORICAL).alias("f"),
        records.graph_to_json(F.col("call_graph")).alias("g"),
    )
    back = records.features_from_json(F.col("f"))
    return texts.select(
        "_id", back.getField("sequence_length(count)").alias("sequence_length"),
        back.getField("ip_type").alias("ip_type"),
        F.size(records.graph_from_json(F.col("g"))).cast("long").alias("edges"),
        F.col("g").isNull().alias("no_graph_text"),
    )
