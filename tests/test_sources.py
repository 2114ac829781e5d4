import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowverdict.functions.http import http_requests
from flowverdict.functions.records import source_ip, validate_features
from flowverdict.operators import graphs as g, metrics as m, sessions as s
from flowverdict.operators.joins import pair_features_graphs
from flowverdict.schemas import MODEL_INPUT, NUMERIC, c
from flowverdict.sources import captures, files

CSV = """source,_id,inter_api_access_duration(sec),api_access_uniqueness,sequence_length(count),\
vsession_duration(min),num_sessions,num_users,num_unique_apis,ip_type,behavior,src_ip
E,t1,1.5,0.5,3,2,1,1,2,default,b,1.2.3.4
E,t2,,0.5,3,2,1,1,2,default,b,
E,t3,NaN,inf,3,2,1,1,2,NA,b,9.9.9.9
E,t1,7,0.5,3,2,1,1,2,other,b,1.2.3.4
"""
GRAPHS = [
    {"_id": "t1", "call_graph": [{"fromId": "/a", "toId": "/b"}]},
    {"_id": "t2", "call_graph": []},
    {"_id": "t3"},
    {"_id": "t1", "call_graph": [{"fromId": "/x", "toId": "/y"}, {"fromId": "/y", "toId": "/z"}]},
    {"_id": 4, "call_graph": None},
]


def test_files_with_other_headers_fail(spark, tmp_path):
    """They must not put values into the wrong columns."""
    names, *rows = CSV.splitlines()
    (tmp_path / "a.csv").write_text("\n".join([names, rows[0]]))
    (tmp_path / "b.csv").write_text("\n".join([names, rows[1]]))
    assert files.read_features(spark, str(tmp_path)).count() == 2
    turn = lambda line: ",".join(line.split(",")[::-1])
    (tmp_path / "c.csv").write_text("\n".join([turn(names), turn(rows[2])]))
    with pytest.raises(Exception, match="header"):
        files.read_features(spark, str(tmp_path)).collect()


def test_feature_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(CSV)
    got = {r["_id"]: r for r in files.read_features(spark, str(path)).collect()}
    assert got["t1"]["inter_api_access_duration(sec)"] == 1.5  # the first row wins
    assert got["t1"]["copies"] == 2 and got["t1"]["ip_type"] == "default"
    assert got["t2"]["inter_api_access_duration(sec)"] is None
    assert got["t3"]["ip_type"] is None and got["t3"]["api_access_uniqueness"] == float("inf")
    rows = files.read_features(spark, str(path))
    assert {r[0] for r in rows.select(source_ip(rows)).collect()} == {"1.2.3.4", "", "9.9.9.9"}
    errors = {r["_id"]: r["error"] for r in validate_features(rows).collect()}
    assert errors == {"t1": None, "t2": f"feature {NUMERIC[0]} is NULL",
                      "t3": f"feature {NUMERIC[0]} is NULL"}
    assert validate_features(rows.drop(NUMERIC[3])).where("_id = 't1'").first()["error"] == (
        f"missing numeric feature: {NUMERIC[3]}")


@pytest.mark.parametrize("lines", [False, True])
def test_graph_json(spark, tmp_path, lines):
    path = tmp_path / "g.json"
    path.write_text("\n".join(map(json.dumps, GRAPHS)) if lines else json.dumps(GRAPHS))
    got = {r["_id"]: r["call_graph"]
           for r in files.read_call_graphs(spark, str(path), lines).collect()}
    assert set(got) == {"t1", "t2", "t3", "4"}
    assert [tuple(e) for e in got["t1"]] == [("/x", "/y"), ("/y", "/z")]
    assert got["t2"] == got["t3"] == got["4"] == []


def test_key_rule(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(CSV)
    features = files.read_features(spark, str(path))

    def ids(graph_ids):
        graphs = spark.createDataFrame(
            [(i, [("/a", "/b")]) for i in graph_ids],
            "_id string, call_graph array<struct<fromId:string,toId:string>>")
        return sorted(r["_id"] for r in pair_features_graphs(features, graphs).collect())

    assert ids(["t1", "t3", "zz"]) == ["t1", "t3"]
    assert ids(["zz"]) == ["t1", "t1", "t2", "t3"]  # no common id: all rows, copies too
    assert ids([]) == ["t1", "t2", "t3"]
    alone = pair_features_graphs(features, None).collect()
    assert len(alone) == 3 and all(r["call_graph"] == [] for r in alone)


def test_exports_read_back(spark, tmp_path, folder):
    from catalog.traffic import features
    rows = features(spark, folder).limit(20)
    files.export_features(rows, str(tmp_path / "csv"))
    back = files.read_features(spark, str(tmp_path / "csv"))
    key = lambda r: r["_id"]
    cols = ["_id", *[c(n) for n in MODEL_INPUT]]
    assert "source_ip" not in back.columns
    assert sorted(rows.select(*cols).collect(), key=key) == sorted(
        back.select(*cols).collect(), key=key)
    edges = spark.createDataFrame([("t", 0, "/a", "/b"), ("t", 1, "/b", "/a")],
                                  "trace_id string, pos long, from_id string, to_id string")
    files.export_graphs(g.collect_graphs(edges), str(tmp_path / "json"))
    got = files.read_call_graphs(spark, str(tmp_path / "json"), lines=True).first()
    assert [tuple(e) for e in got["call_graph"]] == [("/a", "/b"), ("/b", "/a")]
    metrics = m.classification_metrics(
        spark.createDataFrame([(1, 1), (0, 1)], "y int, predicted int"))
    files.export_metrics(metrics, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "json")).first()["tp"] == 1
    files.append_task_results(metrics, str(tmp_path / "r"))
    files.append_task_results(metrics, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def frame(src, dst, sport, dport, payload, proto=6):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 100, 0, 0) + payload
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, proto, 0)
    ip = head + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return b"\0" * 12 + b"\x08\x00" + ip + tcp + b"pad"


def capture(packets, order="<", nano=False):
    magic = struct.pack(order + "I", 0xA1B23C4D if nano else 0xA1B2C3D4)
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for ts, f in packets:
        part = round((ts - int(ts)) * (1e9 if nano else 1e6))
        out += struct.pack(order + "IIII", int(ts), part, len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    get = b"GET /%d HTTP/1.1\r\nHost: h\r\n\r\n"
    talk = [(10.5 + i, frame("10.0.0.1", "10.0.0.2", 5, 80, get % (i % 2))) for i in range(4)]
    talk.append((99.0, b"\0" * 40))
    (tmp_path / "a.pcap").write_bytes(capture(talk))
    (tmp_path / "1.1.1.1_7_2.2.2.2_8.pcap").write_bytes(capture(talk[:1], ">", nano=True))
    (tmp_path / "udp.pcap").write_bytes(capture([(1.0, frame("1.2.3.4", "4.3.2.1", 1, 2, b"x", 17))]))
    (tmp_path / "empty.pcap").write_bytes(capture([]))
    (tmp_path / "broken.pcap").write_bytes(b"no capture")
    (tmp_path / "other.txt").write_bytes(capture(talk))
    found = captures.scan_captures(spark, str(tmp_path), "normal")
    assert found.count() == 5 and found.select("label").distinct().collect() == [("normal",)]
    table = spark.createDataFrame([("a.pcap", "outlier")], "file_name string, label string")
    labels = captures.scan_captures(spark, str(tmp_path), table).where("label = 'outlier'")
    assert [r["file_name"] for r in labels.collect()] == ["a.pcap"]
    decoded = captures.decode_packets(found)
    errors = {r["file_name"]: r["error"] for r in captures.capture_errors(decoded).collect()}
    assert errors == {"empty.pcap": "capture is empty", "broken.pcap": "not a capture file"}
    packets = captures.good_packets(decoded)
    sessions = {r["file_name"]: r for r in s.capture_sessions(packets).collect()}
    assert sessions["a.pcap"]["packet_count"] == 5
    assert (sessions["a.pcap"]["source_ip"], sessions["a.pcap"]["dest_port"]) == ("10.0.0.1", 80)
    assert sessions["1.1.1.1_7_2.2.2.2_8.pcap"]["source_ip"] == "1.1.1.1"
    assert sessions["1.1.1.1_7_2.2.2.2_8.pcap"]["start_time"] == pytest.approx(10.5)
    assert (sessions["udp.pcap"]["source_ip"], sessions["udp.pcap"]["source_port"]) == (
        "1.2.3.4", 0)
    requests = http_requests(packets)
    features = s.session_features(s.capture_sessions(packets), requests).collect()
    by_id = {r["_id"]: r for r in features}
    mine = by_id[sessions["a.pcap"]["trace_id"]]
    assert mine["sequence_length(count)"] == 4.0 and mine["num_unique_apis"] == 2.0
    assert mine["vsession_duration(min)"] == pytest.approx((99.0 - 10.5) / 60)
    assert mine["inter_api_access_duration(sec)"] == pytest.approx(1.0)
    empty = by_id[sessions["udp.pcap"]["trace_id"]]
    assert empty["vsession_duration(min)"] == 0.0 and empty["num_users"] == 1.0
    assert requests.select(F.col("host")).distinct().collect() == [("h",)]


def noisy(n, seed, order="<", largest=900):
    """A capture whose payloads hold bytes that look like packet headers."""
    rng = random.Random(seed)
    packets = []
    for k in range(n):
        lie = struct.pack(order + "IIII", 1_700_000_000 + k, 5, 40, 40) * rng.randint(0, 3)
        body = b"GET /%d HTTP/1.1\r\n\r\n" % k + lie + rng.randbytes(rng.randint(0, largest))
        f = frame("10.0.0.%d" % (k % 9), "10.1.0.1", 5000, 80, body, rng.choice([6, 6, 6, 17]))
        packets.append((1_700_000_000 + k / 4, f))
    return capture(packets, order)


def packet_rows(df):
    return sorted(map(str, df.collect()))


def test_slices_give_the_packets_of_whole_files(spark, tmp_path, monkeypatch):
    whole = noisy(10_000, 1)
    (tmp_path / "a.pcap").write_bytes(whole)
    (tmp_path / "turned.pcap").write_bytes(noisy(800, 2, ">"))
    (tmp_path / "cut.pcap").write_bytes(noisy(500, 3)[:-77])
    (tmp_path / "head.pcap").write_bytes(noisy(500, 4)[:-7] + b"\0" * 3)
    (tmp_path / "large.pcap").write_bytes(noisy(12, 5, largest=60_000))
    (tmp_path / "empty.pcap").write_bytes(capture([]))
    (tmp_path / "broken.pcap").write_bytes(b"no capture" * 9000)
    (tmp_path / "none.pcap").write_bytes(b"")
    # A packet that holds a whole capture: chains of headers that are none of this file.
    inner = [(1_700_000_000 + k, b"\0" * 60 + noisy(150, k)) for k in range(6)]
    (tmp_path / "nested.pcap").write_bytes(capture(inner))
    want = packet_rows(captures.decode_packets(captures.scan_captures(spark, str(tmp_path))))
    assert len(want) > 11_000
    sure = []
    real = captures.sure_slices
    monkeypatch.setattr(captures, "sure_slices", lambda found: sure.append(real(found)) or sure[-1])
    for size, block in ((64 << 20, 8 << 20), (50_000, 8 << 20), (50_000, 3000), (1_000_000, 20_000)):
        monkeypatch.setattr(captures, "BLOCK_BYTES", block)
        assert packet_rows(captures.read_packets(spark, str(tmp_path), size)) == want
    many = {r["file_name"]: r["count"] for r in sure[1].groupBy("file_name").count().collect()}
    assert many["a.pcap"] > len(whole) // 50_000 - 3  # read by as many tasks as it has slices
    assert many["cut.pcap"] > 2 and many["empty.pcap"] == many["broken.pcap"] == 1


def test_many_large_packets(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(noisy(40, 7, largest=60_000))
    want = packet_rows(captures.decode_packets(captures.scan_captures(spark, str(tmp_path))))
    assert packet_rows(captures.read_packets(spark, str(tmp_path), 10_000)) == want


def test_no_captures(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert captures.read_packets(spark, str(tmp_path)).count() == 0
