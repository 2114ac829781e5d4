import glob
import random

import pytest
from pyspark.sql import functions as F

from flowverdict.operators import results as r
from flowverdict.schemas import VERDICT
from flowverdict.sources import verdicts as v
from flowverdict.streaming import detect as sd

ROWS = "trace_id string, timestamp long, final_prob double, is_anomaly int"


def batch(spark, seed, n=40, traces=25):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *(f"t{k}" for k in range(traces))]), rng.choice([None, *range(50)]),
             rng.random(), rng.randint(0, 1)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, ROWS)


def merged(batches):
    """{trace: (batch that made the id, newest row)}"""
    out = {}
    for k, rows in enumerate(batches):
        newest = {}
        for trace, ts, prob, flag in rows:
            key = (ts is not None, ts or 0, prob)
            if trace not in newest or key > newest[trace][0]:
                newest[trace] = (key, (ts, prob, flag))
        for trace, (_, row) in newest.items():
            out[trace] = (out[trace][0] if trace in out else k, row)
    return out


def check(store, batches):
    rows = store.read().collect()
    want = merged(batches)
    assert len(rows) == len(want) == len({x["id"] for x in rows})
    for x in rows:
        made, newest = want[x["trace_id"]]
        assert x["id"] >> v.BATCH_IDS == made
        assert (x["timestamp"], x["final_prob"], x["is_anomaly"]) == newest
    return {x["trace_id"]: x["id"] for x in rows}


@pytest.mark.parametrize("bucket_rows", [1 << 16, 3])
def test_batches_compactions_and_replays(spark, tmp_path, monkeypatch, bucket_rows):
    monkeypatch.setattr(v, "BUCKET_ROWS", bucket_rows)
    store, held, ids = v.VerdictStore(spark, str(tmp_path / "s")), [], {}
    assert store.read().columns == [f.name for f in VERDICT.fields] and store.read().count() == 0
    assert not store.compact()
    for k in range(6):
        rows, df = batch(spark, k)
        assert store.append(df, "live", k)
        held.append(rows)
        now = check(store, held)
        assert {t: now[t] for t in ids} == ids  # known traces keep their ids
        ids = now
        if k in (1, 2, 4):
            before = store.read()
            assert store.compact() and not store.compact()
            assert before.count() == len(ids)  # a reader of the state before goes on
            assert check(store, held) == ids
        for again in range(k + 1):
            assert not store.append(batch(spark, 99)[1], "live", again)
    # All but the batches since the compaction before the last are freed.
    left = {int(p.rsplit("=", 1)[1]) for p in glob.glob(str(tmp_path / "s/verdicts/batch_id=*"))}
    assert left == {3, 4, 5}
    assert len(glob.glob(str(tmp_path / "s/base/*"))) == 2
    assert check(v.VerdictStore(spark, str(tmp_path / "s")), held) == ids


def test_a_batch_that_failed_halfway_is_written_again(spark, tmp_path):
    store = v.VerdictStore(spark, str(tmp_path / "s"))
    first, df = batch(spark, 1)
    store._create("000000000000-claim", {"number": 0, "kind": "claim", "origin": "live", "batch": 0})
    df.limit(3).write.parquet(store._delta(0))  # and then the driver was lost
    assert store.read().count() == 0
    other, tasks = batch(spark, 2)
    assert store.append(tasks, "task:7") and not store.append(tasks, "task:7")
    check(store, [[], other])
    assert store.compact()
    assert store.append(df, "live", 0)  # keeps its number, so its rows are the older ones
    check(store, [first, other])
    assert store.compact()
    check(store, [first, other])


def test_two_writers_never_share_a_number(spark, tmp_path, monkeypatch):
    a, b = (v.VerdictStore(spark, str(tmp_path / "s")) for _ in range(2))
    old = a._state()
    one, first = batch(spark, 1)
    two, second = batch(spark, 2)
    assert b.append(first, "x")
    states = [old]
    real = a._state
    monkeypatch.setattr(a, "_state", lambda: states.pop() if states else real())
    assert a.append(second, "y")  # its first look was too old
    check(b, [one, two])


def test_all_kinds_of_rows_share_the_table(spark, tmp_path):
    store = v.VerdictStore(spark, str(tmp_path / "s"))
    live = spark.createDataFrame([("a", 5, 0.5, 1, "adaptive", 0.4, 0.7)],
                                 ROWS + ", mode string, threshold double, weight_rf double")
    live = live.withColumn("fusion_info", F.struct("mode", "threshold", "weight_rf")).drop(
        "mode", "threshold", "weight_rf")
    store.append(live, "live", 0)
    task = spark.createDataFrame([("b", 6, 0.9, 1, 1, 7, "Nightly")],
                                 ROWS + ", detect_type int, file_id long, task_name string")
    store.append(task, "task:7")
    rows = {x["trace_id"]: x for x in store.read().collect()}
    assert (rows["a"]["mode"], rows["a"]["threshold"], rows["a"]["weight_rf"]) == ("adaptive", 0.4, 0.7)
    assert rows["b"]["task_name"] == "Nightly" and rows["a"]["file_id"] is None
    page = r.results_page(store.read(), 1, 10, task_name="night", min_prob=0.8).collect()
    assert [x["trace_id"] for x in page] == ["b"]
    sd.compact_results(spark, str(tmp_path / "s"), str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_changed_traces_only_meet_the_batches(spark, tmp_path):
    """The stored rows of other traces are read without a shuffle of their own columns."""
    store = v.VerdictStore(spark, str(tmp_path / "s"))
    store.append(batch(spark, 1)[1], "live", 0)
    store.compact()
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
