import json
import random

import pytest
from pyspark.sql import functions as F

from flowverdict.operators import metrics as m, results as r
from flowverdict.sources.messages import read_detect_requests, split_bad_messages
from flowverdict.streaming import detect as sd, live

RESULTS = "id long, trace_id string, source_ip string, timestamp long, final_prob double, " \
          "is_anomaly int, detect_type int, file_id long, task_name string"


def _results(spark):
    return spark.createDataFrame([
        (1, "Ab-1", "1.1.1.1", 1000, 0.2, 0, 0, None, None),
        (2, "ab-2", "1.1.1.2", 2000, 0.5, 1, 1, 7, "Nightly 100%"),
        (3, "zz", None, None, 0.9, 1, 1, 7, "other"),
        (4, "zy", "2.2.2.2", 3000, 0.7, 3, 0, None, None),
    ], RESULTS)


def test_filters(spark):
    df = _results(spark)

    def ids(**k):
        return sorted(x["id"] for x in r.filter_results(df, **k).collect())

    assert ids() == [1, 2, 3, 4] and ids(trace_id="  ") == [1, 2, 3, 4]
    assert ids(trace_id="AB") == [1, 2] and ids(task_name="100%") == [2]
    assert ids(min_prob=0.5, max_prob=0.9) == [2, 3, 4]
    assert ids(start_time=1000, end_time=2000) == [1, 2] and ids(file_id=7, source_ip="1.1") == [2]
    assert r.detection_statistics(df).first().asDict() == {"normal": 1, "anomaly": 2, "total": 3}
    assert [x["id"] for x in r.results_page(df, 1, 3).collect()] == [4, 2, 1]
    assert [x["id"] for x in r.results_page(df, 2, 3).collect()] == [3]
    assert [x["id"] for x in r.time_range(df, "custom", start=1000, end=2000).collect()] == [1, 2]
    assert r.time_range(df, "1h", now=3_602_000).count() == 2
    assert r.live_counters(df, now=100_000, start=1500).first().asDict() == {
        "total": 2, "anomaly": 1}
    assert r.live_counters(df, now=100_000, end=30_000).first()["total"] == 0


def test_upsert_keeps_ids(spark):
    schema = "trace_id string, id long, final_prob double, arrival long"
    old = spark.createDataFrame([("a", 1, 0.1, 5), ("b", 2, 0.2, 5)], schema)
    new = spark.createDataFrame([("a", 8, 0.7, 1), ("a", 9, 0.9, 2), ("c", 10, 0.3, 1)], schema)
    got = {x["trace_id"]: (x["id"], x["final_prob"])
           for x in r.upsert_by_trace(old, new).collect()}
    assert got == {"a": (1, 0.9), "b": (2, 0.2), "c": (10, 0.3)}


def test_metrics_with_zero_denominators(spark):
    rows = [("none", 0, 0), ("none", 0, 0), ("missed", 1, 0), ("missed", 0, 0), ("hit", 1, 1)]
    df = spark.createDataFrame(rows, "g string, y int, predicted int")
    got = {x["g"]: x for x in m.classification_metrics(df, ["g"]).collect()}
    assert (got["none"]["f1"], got["none"]["fnr"], got["none"]["accuracy"]) == (0.0, 0.0, 1.0)
    assert (got["missed"]["precision"], got["missed"]["fnr"]) == (0.0, 1.0)
    assert (got["hit"]["f1"], got["hit"]["fpr"]) == (1.0, 0.0)
    cells = spark.createDataFrame([(0, 0.0, 0.5), (1, 0.4, 0.2), (2, 0.4, 0.2), (3, 0.9, 0.3)],
                                  "cell long, f1 double, fnr double")
    assert m.pick_best(cells).first()["cell"] == 3
    assert m.pick_best(cells, "min_fnr").first()["cell"] == 1
    assert m.pick_best(cells.where("f1 = 0")).count() == 0


def _messages():
    feats = {"sequence_length(count)": 3.0, "ip_type": "default", "source": "E"}
    graph = [{"fromId": "/a", "toId": "/b"}]
    both = {"traceId": "both", "sourceIp": "1.1.1.1", "timestamp": 5, "features": feats,
            "callGraph": graph}
    return [
        json.dumps(both),
        json.dumps({"traceId": "rf", "features": feats}),
        json.dumps({"traceId": "gcn", "callGraph": graph, "features": {}}),
        json.dumps({"traceId": "none"}),
        '{"traceId": "broken", ',
        "not json",
    ]


@pytest.fixture(scope="module")
def models(spark, folder):
    from catalog.learning import models
    return models(spark, folder)


def test_stream_equals_batch_and_survives_replay(spark, models, tmp_path):
    texts = _messages()
    batch = spark.createDataFrame([(t,) for t in texts], "value string")
    want = {x["trace_id"]: x for x in sd.detect_stream(batch, models).collect()}
    assert {k: v["fusion_info"]["mode"] for k, v in want.items()} == {
        "both": want["both"]["fusion_info"]["mode"], "rf": "rf_only", "gcn": "gcn_only",
        "none": "consistent"}
    assert want["none"]["final_prob"] == 0.0 and want["rf"]["source_ip"] == ""
    assert json.loads(want["both"]["features_json"])["sequence_length(count)"] == 3.0
    assert split_bad_messages(batch)[1].count() == 2

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in (0, 3):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(texts[i : i + 3]))
        stream = read_detect_requests(spark, source, max_files=1)
        sd.write_detect_results(stream, models, out, state).awaitTermination()
    newer = json.loads(texts[1]) | {"sourceIp": "9.9.9.9", "timestamp": 7}
    (tmp_path / "in" / "9.txt").write_text(json.dumps(newer))
    sd.write_detect_results(
        read_detect_requests(spark, source), models, out, state).awaitTermination()
    got = {x["trace_id"]: x for x in sd.read_results(spark, out).collect()}
    assert set(got) == set(want) and got["rf"]["source_ip"] == "9.9.9.9"
    for k in want:
        assert got[k]["final_prob"] == want[k]["final_prob"]
    assert spark.read.parquet(f"{out}/bad_messages").count() == 2
    # A replay writes the same partition again and changes nothing.
    spark.read.parquet(f"{out}/verdicts/batch_id=0").write.mode("overwrite").parquet(
        str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(
        f"{out}/verdicts/batch_id=0")
    assert sd.read_results(spark, out).count() == len(want)
    sd.compact_results(spark, out, str(tmp_path / "base"))
    assert spark.read.parquet(str(tmp_path / "base")).count() == len(want)


EVENTS = [
    ("a", 1, "result", "early"), ("a", 2, "request", None), ("a", 3, "request", None),
    ("a", 4, "result", "r1"), ("a", 5, "request", None), ("a", 6, "error", None),
    ("b", 1, "request", None), ("b", 2, "result", "r2"), ("c", 1, "error", None),
]
EVENT_SCHEMA = "trace_id string, ord long, kind string, payload string"
STATES = {"a": (2, "r1", 2), "b": (1, "r2", 1)}


@pytest.mark.parametrize("cuts", [[9], [1, 4, 9], list(range(1, 10))])
def test_lifecycle_does_not_depend_on_batches(spark, tmp_path, cuts):
    df = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    want = {x["trace_id"]: (x["status"], x["payload"], x["jobs"])
            for x in r.explain_lifecycle(df).collect()}
    assert want == STATES
    folder = str(tmp_path / "events")
    lo = 0
    for hi in cuts:
        spark.createDataFrame(EVENTS[lo:hi], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(
            folder)
        lo = hi
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
        live.write_explain_lifecycle(
            stream, f"{tmp_path}/out", str(tmp_path / "state")).awaitTermination()
    got = live.read_explain_lifecycle(spark, f"{tmp_path}/out")
    assert {x["trace_id"]: (x["status"], x["payload"], x["jobs"]) for x in got.collect()} == want


def test_lifecycles_by_any_cuts_and_compactions(spark, tmp_path):
    rng = random.Random(4)
    events = [(f"t{rng.randint(0, 8)}", k, rng.choice(["request", "result", "error"]),
               rng.choice([None, f"p{k}"])) for k in range(90)]
    whole = spark.createDataFrame(events, EVENT_SCHEMA)
    want = {x["trace_id"]: (x["status"], x["payload"], x["jobs"]) for x in r.explain_lifecycle(whole).collect()}
    for seed in range(3):
        store, lo, number = live.LifecycleStore(spark, f"{tmp_path}/{seed}"), 0, 0
        while lo < len(events):
            hi = lo + rng.choice([1, 5, 20, 40])
            part = spark.createDataFrame(events[lo:hi], EVENT_SCHEMA)
            assert store.append(part, "e", number) and not store.append(part, "e", number)
            lo, number = hi, number + 1
            if rng.random() < 0.5:
                store.compact()
        got = {x["trace_id"]: (x["status"], x["payload"], x["jobs"]) for x in store.read().collect()}
        assert got == want


def test_finished_requests_can_be_forgotten(spark, tmp_path):
    store = live.LifecycleStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame(EVENTS + [("d", 1, "request", None)], EVENT_SCHEMA), "e", 0)
    assert store.forget("2100-01-01")
    assert [tuple(x) for x in store.read().collect()] == [("d", 0, None, 1)]
    late = [("a", 7, "result", "late"), ("d", 2, "result", "ok"), ("b", 3, "request", None)]
    store.append(spark.createDataFrame(late, EVENT_SCHEMA), "e", 1)
    assert store.forget("2000-01-01")
    assert {x["trace_id"]: tuple(x)[1:] for x in store.read().collect()} == {
        "d": (1, "ok", 1), "b": (0, None, 1)}


def test_late_rows_correct_their_second(spark, tmp_path):
    store = live.RateStore(spark, str(tmp_path / "s"))
    parts = [[("00:00:01.5", 1), ("00:00:02.5", 0)], [("00:00:09", 1), ("00:00:01.1", 0), (None, 1)], [("00:00:01", 1)]]
    for k, part in enumerate(parts):
        df = spark.createDataFrame([(t and f"2024-01-01 {t}", a) for t, a in part], "t string, is_anomaly int")
        df = df.withColumn("event_time", F.to_timestamp("t"))
        assert store.append(df, "live", k) and not store.append(df, "live", k)
        if k == 1:
            assert store.compact()
    got = {str(x["second"])[-8:]: (x["qps"], x["anomalies"]) for x in store.read().collect()}
    assert got == {"00:00:01": (3, 2), "00:00:02": (1, 0), "00:00:09": (1, 1)}
    assert [str(x["second"])[-8:] for x in store.corrected(1).collect()] == ["00:00:01"]


def test_rate_series_fills_gaps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:58.2", 1), ("2024-01-01 00:00:58.9", 0),
                                ("2023-12-31 23:00:00", 1)], "t string, is_anomaly int")
    rates = r.per_second_rates(df.withColumn("event_time", F.to_timestamp("t")))
    got = {str(x["second"]): (x["qps"], x["anomalies"])
           for x in r.rate_series(rates, "2024-01-01 00:01:00", 60).collect()}
    assert len(got) == 60 and got["2024-01-01 00:00:58"] == (2, 1)
    assert sum(q for q, _ in got.values()) == 2
