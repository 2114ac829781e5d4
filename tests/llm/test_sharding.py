import zlib
from collections import Counter

import numpy as np

from flowverdict.llm import sharding as s


def walked(key, shards):
    """The published loop, one key at a time."""
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_is_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert s.jump(keys, shards).tolist() == [walked(int(k), shards) for k in keys]


def test_a_new_shard_takes_rows_only_into_itself():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before, after = s.jump(keys, 16), s.jump(keys, 17)
    moved = before != after
    assert set(after[moved]) == {16}
    assert abs(moved.mean() - 1 / 17) < 0.01


def test_manifest(spark, documents, hard):
    rows = hard + [(i, "copy") for i in range(100, 400)]
    out = s.manifest(documents(rows, ["shard", "slot"])).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shard_depends_on_the_key_alone(spark, documents):
    one = {r["doc_id"]: r["shard"] for r in s.manifest(documents([(i, "x") for i in range(50)])).collect()}
    two = {r["doc_id"]: r["shard"] for r in s.manifest(documents([(i, "y" * i) for i in range(99)])).collect()}
    assert all(two[i] == k for i, k in one.items())


def test_empty_table(spark, documents):
    assert s.manifest(documents([])).count() == 0


def test_written_shards_hold_all_rows(spark, documents, hard, tmp_path):
    docs = documents(hard, ["shard"])
    s.write_shards(docs, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(hard) and set(docs.columns) - {"shard"} <= set(back.columns)
    assert {r["_shard"] for r in back.collect()} == {"clash"}
