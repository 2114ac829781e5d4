"""DuckDB forms of the derived tables, written independently of the Spark code.

``sql(body)`` puts the needed definitions in front of a query, following names.
"""

from __future__ import annotations

import re

VIEWS = {
    "packets": """
        SELECT user_id::VARCHAR || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS trace_id,
               event_id AS pkt_no,
               epoch_us(ts) / 1e6::DOUBLE AS ts,
               CASE user_id % 5 WHEN 0 THEN '127.0.0.' || (user_id % 250)
                                WHEN 1 THEN '192.168.1.' || (user_id % 250)
                                WHEN 2 THEN '10.1.2.' || (user_id % 250)
                                WHEN 3 THEN '172.' || (16 + user_id % 20) || '.0.1'
                                ELSE '8.8.8.' || (user_id % 250) END AS src_ip,
               '10.0.0.1' AS dst_ip,
               (40000 + user_id % 1000)::INTEGER AS src_port,
               8080::INTEGER AS dst_port,
               '/' || event_type || '/v1/' ||
                   (json_extract_string(props, '$.k')::INTEGER % 10) AS path,
               event_type, ts AS event_time
        FROM events""",
    "requests": """
        SELECT trace_id, pkt_no, ts, path,
               row_number() OVER (PARTITION BY trace_id ORDER BY ts, pkt_no) - 1 AS seq
        FROM packets""",
    "sessions": """
        SELECT trace_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS packet_count,
               arg_min(src_ip, pkt_no) AS source_ip, arg_min(dst_ip, pkt_no) AS dest_ip,
               arg_min(src_port, pkt_no) AS source_port, arg_min(dst_port, pkt_no) AS dest_port
        FROM packets GROUP BY trace_id""",
    "edges": """
        SELECT a.trace_id, a.seq AS pos, a.path AS from_id, b.path AS to_id
        FROM requests a JOIN requests b ON a.trace_id = b.trace_id AND b.seq = a.seq + 1""",
    "nodes": """
        SELECT trace_id, from_id AS node_id FROM edges
        UNION SELECT trace_id, to_id FROM edges""",
    "degrees": """
        SELECT n.trace_id, n.node_id,
               (SELECT count(*) FROM edges e WHERE e.trace_id = n.trace_id
                   AND e.from_id = n.node_id) AS out_degree,
               (SELECT count(*) FROM edges e WHERE e.trace_id = n.trace_id
                   AND e.to_id = n.node_id) AS in_degree
        FROM nodes n""",
    "measures": """
        SELECT r.trace_id,
               coalesce(avg(gap) FILTER (gap >= 0), 0.0) AS mean_gap,
               count(DISTINCT path) / count(*)::DOUBLE AS uniqueness,
               count(*)::DOUBLE AS sequence_length,
               count(DISTINCT path)::DOUBLE AS unique_apis
        FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY trace_id ORDER BY ts, pkt_no) AS gap
              FROM requests) r GROUP BY r.trace_id""",
    "simple_edges": """
        SELECT DISTINCT trace_id, from_id, to_id FROM edges WHERE from_id <> to_id""",
    "neighbours": """
        SELECT trace_id, from_id AS a, to_id AS b FROM simple_edges
        UNION SELECT trace_id, to_id, from_id FROM simple_edges""",
    "clustering": """
        SELECT k.trace_id, k.a AS node_id,
               CASE WHEN k.k < 2 THEN 0.0 ELSE coalesce(t.t, 0) / (k.k * (k.k - 1.0)) END AS c
        FROM (SELECT trace_id, a, count(*) AS k FROM neighbours GROUP BY 1, 2) k
        LEFT JOIN (SELECT x.trace_id, x.a, count(*) AS t
                   FROM neighbours x
                   JOIN neighbours y ON x.trace_id = y.trace_id AND x.a = y.a AND x.b <> y.b
                   JOIN neighbours z ON z.trace_id = x.trace_id AND z.a = x.b AND z.b = y.b
                   GROUP BY 1, 2) t ON t.trace_id = k.trace_id AND t.a = k.a""",
    "topology": """
        SELECT v.trace_id,
               CASE WHEN v.v < 2 THEN 0.0
                    ELSE coalesce(e.e, 0) / (v.v * (v.v - 1.0)) END AS graph_density,
               coalesce(i.m, 0)::DOUBLE AS max_in_degree,
               coalesce(c.c, 0.0) / v.v AS avg_clustering
        FROM (SELECT trace_id, count(*) AS v FROM nodes GROUP BY 1) v
        LEFT JOIN (SELECT trace_id, count(*) AS e FROM simple_edges GROUP BY 1) e USING (trace_id)
        LEFT JOIN (SELECT trace_id, max(k) AS m FROM
                      (SELECT trace_id, to_id, count(*) AS k FROM simple_edges GROUP BY 1, 2)
                   GROUP BY 1) i USING (trace_id)
        LEFT JOIN (SELECT trace_id, sum(c) AS c FROM clustering GROUP BY 1) c USING (trace_id)""",
    "ip_types": """
        SELECT trace_id, source_ip,
               CASE WHEN regexp_matches(source_ip,
                   '^(127\\.|192\\.168\\.|10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)')
               THEN 'private_ip' ELSE 'default' END AS ip_type
        FROM sessions""",
    "features": """
        SELECT s.trace_id AS _id,
               m.mean_gap AS "inter_api_access_duration(sec)",
               m.uniqueness AS api_access_uniqueness,
               m.sequence_length AS "sequence_length(count)",
               CASE WHEN s.end_time > s.start_time THEN (s.end_time - s.start_time) / 60.0::DOUBLE
                    ELSE 0.0 END AS "vsession_duration(min)",
               i.ip_type, 1.0::DOUBLE AS num_sessions, 1.0::DOUBLE AS num_users,
               m.unique_apis AS num_unique_apis, 'E' AS source,
               coalesce(t.graph_density, 0.0) AS graph_density,
               coalesce(t.max_in_degree, 0.0) AS max_in_degree,
               coalesce(t.avg_clustering, 0.0) AS avg_clustering,
               s.source_ip
        FROM sessions s JOIN measures m USING (trace_id) JOIN ip_types i USING (trace_id)
        LEFT JOIN topology t USING (trace_id)""",
    "scores": """
        SELECT event_id::VARCHAR AS trace_id, event_id,
               (event_id * 31 % 997) / 997.0::DOUBLE AS rf,
               (event_id * 7919 % 1009) / 1009.0::DOUBLE AS gcn,
               (event_type = 'error')::INTEGER AS y, event_type
        FROM events""",
    "judged": """
        SELECT *, abs(rf - 0.5::DOUBLE) * 2 AS conf_rf, abs(gcn - 0.5::DOUBLE) * 2 AS conf_gcn,
               (rf > 0.5::DOUBLE)::INTEGER AS hard_rf, (gcn > 0.5::DOUBLE)::INTEGER AS hard_gcn
        FROM scores""",
    "adaptive": """
        SELECT *, w * rf + (1.0::DOUBLE - w) * gcn AS prob FROM (
            SELECT *,
              CASE WHEN hard_rf = hard_gcn THEN 0.4::DOUBLE
                   WHEN hard_rf = 1 AND conf_rf > 0.5::DOUBLE THEN 0.4::DOUBLE
                   WHEN hard_rf = 1 THEN 0.15::DOUBLE
                   WHEN conf_gcn > 0.5::DOUBLE THEN 1.0::DOUBLE - 0.4::DOUBLE
                   ELSE 0.4::DOUBLE END AS w,
              CASE WHEN hard_rf = hard_gcn THEN 0.5::DOUBLE
                   WHEN hard_rf = 1 THEN 0.5::DOUBLE + 0.1::DOUBLE * (1.0::DOUBLE - conf_rf)
                   ELSE 0.5::DOUBLE - 0.05::DOUBLE * conf_gcn END AS threshold,
              CASE WHEN hard_rf = hard_gcn THEN 'consistent'
                   WHEN hard_rf = 1 AND conf_rf > 0.5::DOUBLE THEN 'rf_high_conf'
                   WHEN hard_rf = 1 THEN 'rf_low_conf'
                   WHEN conf_gcn > 0.5::DOUBLE THEN 'gcn_high_conf'
                   ELSE 'gcn_low_conf' END AS mode
            FROM judged)""",
    "results": """
        SELECT a.event_id AS id, 'evt-' || a.event_id AS trace_id, p.trace_id AS session,
               p.src_ip AS source_ip, epoch_us(p.event_time) // 1000 AS timestamp,
               a.rf AS rf_prob, a.gcn AS gcn_prob, a.prob AS final_prob,
               (a.prob > a.threshold)::INTEGER AS is_anomaly,
               (a.event_id % 2)::INTEGER AS detect_type,
               CASE WHEN a.event_id % 2 = 1 THEN a.event_id % 7 END AS file_id,
               'Task ' || a.event_type AS task_name, p.event_time, a.event_type
        FROM adaptive a JOIN packets p ON p.pkt_no = a.event_id""",
    "raw_http": """
        SELECT host AS trace_id, CASE WHEN blank THEN -1 - page_id ELSE page_id END AS pkt_no, host, path,
               CASE WHEN page_id % 7 = 0 THEN 'get' WHEN page_id % 7 = 1 THEN 'POST'
                    WHEN page_id % 7 = 2 THEN 'CONNECT' ELSE 'GET' END AS verb,
               page_id, html, blank
        FROM (SELECT *, split_part(split_part(url, '://', 2), '/', 1) AS host,
                     '/' || regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) AS path
              FROM (SELECT *, FALSE AS blank FROM pages
                    UNION ALL SELECT *, TRUE FROM pages WHERE page_id % 5 = 0))""",
    "http_requests": """
        SELECT trace_id, pkt_no, verb AS method, path, trim(host) AS host,
               CASE WHEN page_id % 2 = 0 THEN 'probe/1.0' END AS user_agent,
               CASE WHEN page_id % 3 = 0 THEN 'text/html' END AS content_type,
               CASE WHEN NOT blank
                    THEN nullif(trim(html, E' \\t\\n\\r\\x0b\\x0c'), '') END AS body
        FROM raw_http WHERE verb IN ('GET', 'POST')""",
    "dirty": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS _id,
               CASE WHEN key % 11 = 0 THEN 'nan'::DOUBLE ELSE l_tax END AS n1,
               CASE WHEN key % 13 = 0 THEN 'inf'::DOUBLE ELSE l_discount END AS n2,
               CASE WHEN key % 17 = 0 THEN NULL ELSE l_quantity END AS n3,
               CASE WHEN key % 19 = 0 THEN '-inf'::DOUBLE ELSE l_extendedprice END AS n4,
               1.0::DOUBLE AS n5, 1.0::DOUBLE AS n6, l_linenumber::DOUBLE AS n7,
               CASE WHEN key % 23 = 0 THEN NULL ELSE l_returnflag END AS ip_type,
               l_linestatus AS source
        FROM (SELECT *, l_orderkey * 10 + l_linenumber AS key FROM lineitem)""",
    "tasks": """
        SELECT o_orderkey AS id, 'Batch ' || o_orderpriority AS task_name,
               o_orderstatus AS status, o_orderdate AS create_time, o_custkey AS custkey
        FROM orders""",
    "vectors": """
        SELECT vec_id::VARCHAR AS _id, embedding::DOUBLE[] AS x, (label = 0)::INTEGER AS y
        FROM embeddings""",
}

_NAMES = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needed(text: str, seen: list[str]) -> None:
    for name in dict.fromkeys(_NAMES.findall(text)):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def sql(body: str, **extra: str) -> str:
    """``body`` with the views it names, and ``extra`` views after them, in front."""
    seen: list[str] = []
    _needed(" ".join([*extra.values(), body]), seen)
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in seen if n not in extra]
    parts += [f"{n} AS ({q.strip()})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
