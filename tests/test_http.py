from pyspark.sql import functions as F

from flowverdict.functions import http
from flowverdict.operators import sessions as s

TEXTS = [
    (1, b"GET /a?x=1 HTTP/1.1\r\nHost: one\r\nHOST:  two \r\nUser-Agent: ua\r\n\r\n  hi \r\n"),
    (2, b"POST /b HTTP/1.0\r\nContent-Type: text/plain\r\n \r\nHost: late\r\n\r\nbody"),
    (3, b"get /low HTTP/1.1\r\n\r\n"),
    (4, b"CONNECT x:1 HTTP/1.1\r\n\r\n"),
    (5, b"HTTP/1.1 200 OK\r\n\r\n"),
    (6, b"GET /latin/\xe9 HTTP/1.1\r\n\r\n"),
    (7, b"GETX /no HTTP/1.1\r\n\r\n"),
    (8, b"PUT /p http/1.1\r\n\r\n   \r\n"),
    (9, None),
    (10, b"GET\t/tab  HTTP/2 trailing\r\n\r\n"),
]


def test_requests(spark):
    df = spark.createDataFrame([("t", n, float(n), p) for n, p in TEXTS],
                               "trace_id string, pkt_no long, ts double, payload binary")
    got = {r["pkt_no"]: r for r in http.http_requests(df).collect()}
    assert sorted(got) == [1, 2, 6, 8, 10]
    assert got[1]["path"] == "/a?x=1" and got[1]["host"] == "two" and got[1]["body"] == "hi"
    assert got[1]["user_agent"] == "ua" and got[1]["content_type"] is None
    assert got[2]["host"] == "" and got[2]["content_type"] == "text/plain"
    assert got[2]["body"] == "body"
    assert got[6]["path"] == "/latin/é"
    assert got[8]["method"] == "PUT" and got[8]["body"] is None
    assert got[10]["path"] == "/tab"


def test_names_and_addresses(spark):
    names = ["127.0.0.1_49153_127.0.0.1_8888.pcap", "x_y_z_w.pcap", "a_1_b.pcap", "a_1_b_2_c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r[0]) for r in df.select(http.capture_name_parts(F.col("n"))).collect()]
    assert got == [("127.0.0.1", 49153, "127.0.0.1", 8888), (None,) * 4, (None,) * 4,
                   ("a", 1, "b", 2)]
    ips = {"127.0.0.1": 1, "192.168.3.4": 1, "10.0.0.1": 1, "172.16.0.1": 1, "172.31.9.9": 1,
           "172.32.0.1": 0, "172.x.0.1": 0, "8.8.8.8": 0, "": 0, "unknown": 0, "172.": 0}
    df = spark.createDataFrame([(i,) for i in ips], "i string")
    got = {r["i"]: r["t"] for r in df.select("i", http.ip_type(F.col("i")).alias("t")).collect()}
    assert {k: int(v == "private_ip") for k, v in got.items()} == ips
    paths = {"/identity/api": "identity", "//x": "x", "": "unknown", "/": "unknown", "a/b": "a"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r["p"]: r["s"] for r in df.select("p", http.service_name(F.col("p")).alias("s"))
           .collect()}
    assert got == paths


def test_sessions_from_names_and_packets(spark):
    rows = [
        ("a", "1.1.1.1_5_2.2.2.2_6.pcap", 0, 5.0, "9.9.9.9", "8.8.8.8", 1, 2),
        ("b", "plain.pcap", 0, 7.0, None, None, None, None),
        ("b", "plain.pcap", 1, 3.0, "9.9.9.9", "8.8.8.8", None, None),
        ("b", "plain.pcap", 2, 9.0, "7.7.7.7", "6.6.6.6", 11, 12),
        ("c", None, 0, 1.0, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "trace_id string, file_name string, pkt_no long, ts double, src_ip string, "
              "dst_ip string, src_port int, dst_port int")
    got = {r["trace_id"]: r for r in s.capture_sessions(df).collect()}
    assert (got["a"]["source_ip"], got["a"]["dest_port"]) == ("1.1.1.1", 6)
    assert (got["b"]["source_ip"], got["b"]["source_port"]) == ("9.9.9.9", 11)
    assert (got["b"]["start_time"], got["b"]["end_time"], got["b"]["packet_count"]) == (3.0, 9.0, 3)
    assert (got["c"]["source_ip"], got["c"]["source_port"]) == ("unknown", 0)
