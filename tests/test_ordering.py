import random

import pytest

from flowverdict.operators import explain as ex, graphs as g, prepare as pr, results as r
from flowverdict.operators import sessions as s
from flowverdict.operators.ordering import in_order
from flowverdict.streaming.live import lifecycle_summaries


def _requests(spark, n=400):
    """A third of all rows in one capture, many equal times."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"t{rng.randrange(40)}", i, float(rng.randrange(50)),
             f"/p{rng.randrange(6)}") for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, pkt_no long, ts double, path string")


@pytest.mark.parametrize("part_rows", [5, 20, 100])
def test_sliced_order_equals_plain_order(spark, part_rows):
    df = _requests(spark)
    args = dict(index="i", previous={"p": "path"}, following={"n": "path"})
    plain = in_order(df, ["trace_id"], ["ts", "pkt_no"], **args)
    sliced = in_order(df, ["trace_id"], ["ts", "pkt_no"], part_rows=part_rows, **args)
    assert sorted(plain.collect()) == sorted(sliced.collect())


def test_new_columns_may_have_any_name(spark):
    df = _requests(spark)
    names = ["_before", "_n", "_last", "_first"]
    args = dict(index="i", previous={n: "path" for n in names[:2]}, following={n: "path" for n in names[2:]})
    plain = in_order(df, ["trace_id"], ["ts", "pkt_no"], **args)
    sliced = in_order(df, ["trace_id"], ["ts", "pkt_no"], part_rows=20, **args)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_lifecycles_of_many_parts(spark):
    """Requests whose events several parts share, in the batch and in the stream's summary."""
    kind = "element_at(array('request', 'request', 'result', 'error'), int(xxhash64(id) & 3) + 1)"
    events = spark.range(600).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('t', id % 7)) AS trace_id", "id AS ord", f"{kind} AS kind",
        "concat('p', id) AS payload")
    for job in (r.explain_lifecycle, lifecycle_summaries):
        assert sorted(map(str, job(events, part_rows=50).collect())) == sorted(map(str, job(events).collect()))


def test_bounds_may_be_infinite_or_text(spark):
    df = _requests(spark).selectExpr(
        "trace_id", "pkt_no", "IF(ts > 30, DOUBLE('Infinity'), ts / 3) AS age",
        "concat('\"é\\\\', path) AS name")
    for order in (["age", "pkt_no"], ["name", "pkt_no"]):
        plain = in_order(df, [], order, index="i", following={"n": "age"})
        sliced = in_order(df, [], order, index="i", following={"n": "age"}, part_rows=11)
        assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_many_large_keys_and_any_order_type(spark):
    """1,500 keys of which each spans parts, ordered by a date and a decimal."""
    df = spark.range(9000).selectExpr(
        "id % 1500 AS k", "date_add(DATE'2024-01-01', int(id / 1500)) AS d", "CAST(id AS decimal(12,2)) AS x")
    args = dict(index="i", previous={"p": "x"}, following={"n": "d"})
    plain = in_order(df, ["k"], ["d", "x"], **args)
    cut = in_order(df, ["k"], ["d", "x"], part_rows=4, **args)
    assert sorted(plain.collect()) == sorted(cut.collect())


def test_exploded_rows_are_counted_and_parts_are_bounded(spark):
    """Few input rows that multiply: the parts follow the rows there are, not an estimate."""
    df = spark.range(4).selectExpr("id % 2 AS k", "explode(sequence(1, 5000)) AS x", "id").repartition(1)
    plan = in_order(df, ["k"], ["x", "id"], index="i", part_rows=1000)
    assert sorted(r["i"] for r in plan.where("k = 0").collect()) == list(range(10_000))
    held = spark.read.parquet(*[f for f in plan.inputFiles() if "/ranged-" in f])
    sizes = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 1000


def test_users_of_the_order_are_safe_for_hot_keys(spark):
    df = _requests(spark)
    for call in (g.call_edges, s.order_requests, s.request_gaps):
        assert sorted(map(str, call(df).collect())) == sorted(
            map(str, call(df, part_rows=7).collect()))
    assert sorted(r.sequence_timestamps(df, 1000, ["ts", "pkt_no"], "trace_id").collect()) == (
        sorted(r.sequence_timestamps(df, 1000, ["ts", "pkt_no"], "trace_id", 9).collect()))


def test_mean_gap_equals_windowed_gaps(spark):
    df = _requests(spark)
    mean = {x["trace_id"]: x["mean_gap"] for x in s.request_measures(df).collect()}
    gaps = {}
    for x in s.request_gaps(df).collect():
        gaps.setdefault(x["trace_id"], [])
        if x["gap"] is not None:
            gaps[x["trace_id"]].append(x["gap"])
    for k, v in gaps.items():
        assert mean[k] == pytest.approx(sum(v) / len(v) if v else 0.0)


def test_deep_page_equals_shallow_page(spark):
    df = _requests(spark).selectExpr("pkt_no AS id", "CAST(ts AS long) AS timestamp")
    df = df.unionByName(df.selectExpr("id + 1000 AS id", "CAST(NULL AS long) AS timestamp"))
    for current in (1, 7, 60, 80):
        shallow = r.page(df, "timestamp", "id", current, 10)
        deep = r.page(df, "timestamp", "id", current, 10, deep=0)
        assert sorted(shallow.collect()) == sorted(deep.collect())


def test_percentile_of_hot_graphs(spark):
    np = pytest.importorskip("numpy")
    df = _requests(spark).selectExpr("trace_id", "pkt_no AS pos", "ts / 7 AS importance")
    values = {}
    for x in df.collect():
        values.setdefault(x["trace_id"], []).append(x["importance"])
    for part_rows in (2_000_000, 6):
        got = {x["trace_id"]: x["threshold"]
               for x in ex.edge_threshold(df, part_rows=part_rows).collect()}
        for k, v in values.items():
            assert got[k] == np.percentile(v, 90)


def test_exact_shares(spark):
    df = spark.range(1003).selectExpr("CAST(id AS string) AS _id", "id % 10 = 0 AS y")
    got = pr.stratified_split(df, [0.6, 0.2, 0.2], "_id", "y").groupBy("y", "part").count()
    sizes = {(x["y"], x["part"]): x["count"] for x in got.collect()}
    assert sizes == {(True, 0): 61, (True, 1): 20, (True, 2): 20,
                     (False, 0): 541, (False, 1): 181, (False, 2): 180}
