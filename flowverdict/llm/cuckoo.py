"""Exact dedup with an index of live digests behind cuckoo filters.

Texts are known by the SHA-256 of their normalised form. Digests are dealt into shards; a shard
has a cuckoo filter of 16-bit fingerprints, and its digests, with the ids of their rows, are
stored in shard order. A batch of rows is first summed up inside its tasks, then probes the
filters: what they do not know is new for certain, what they seem to know is joined with the
stored digests, so only hits read what is stored. New digests are added to the filters; when the
last row of a digest is deleted, its fingerprint leaves them. A filter that gets too full is
built anew, twice as large, from the stored digests of its shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, table, unused
from .registry import query
from .words import mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS, KICKS, FULL = 4, 200, 0.9
SHARD_ROWS, LEAST_SHARDS = 1 << 16, 256
HELD = 1 << 16  # distinct digests a task sums up before it hands them on
CHUNK = 4096  # digests probed at a time


class CuckooFilter:
    """Fingerprints of 64-bit keys in buckets of four slots; every key has two buckets.

    One fingerprint per inserted key, so a key that was inserted can be deleted again.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None, keys: int = 0):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots
        self.keys = keys

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * FULL < keys:
            buckets *= 2
        return cls(buckets)

    @classmethod
    def of(cls, keys: np.ndarray, least: int = 0) -> CuckooFilter:
        """A filter of distinct ``keys``, doubled until all find a place."""
        out = cls.sized(max(len(keys), least))
        while not out.insert(keys):
            out = cls(2 * len(out.slots))
        return out

    @property
    def room(self) -> int:
        return int(self.slots.size * FULL) - self.keys

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = ((keys >> np.uint64(40)) % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return prints, (mixed(keys) % np.uint64(len(self.slots))).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(prints.astype(np.uint64)) % np.uint64(len(self.slots))).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False: certainly not inserted. True: inserted, or equal in bucket and fingerprint."""
        prints, bucket = self._places(keys)
        first = (self.slots[bucket] == prints[:, None]).any(axis=1)
        return first | (self.slots[self._other(bucket, prints)] == prints[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds ``keys``; False, and nothing is changed, if one finds no place."""
        slots = self.slots.copy()
        prints, bucket = self._places(keys)
        for turn in range(KICKS):
            if not len(prints):
                break
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            places, first = np.unique(bucket, return_index=True)
            rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            free = np.argsort(slots[bucket] != 0, axis=1, kind="stable")  # empty slots first
            fits = rank < (slots[bucket] == 0).sum(axis=1)
            slots[bucket[fits], free[fits, rank[fits]]] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if turn and len(prints):  # one of a bucket takes a slot, what was there moves on
                places, first = np.unique(bucket, return_index=True)
                slot = (mixed(places.astype(np.uint64) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
                out = slots[places, slot]
                slots[places, slot] = prints[first]
                prints[first] = out
            bucket = self._other(bucket, prints)
        if len(prints):
            return False
        self.slots, self.keys = slots, self.keys + len(keys)
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes one fingerprint of each key out; only keys that were inserted may be given."""
        for key in keys:
            prints, bucket = self._places(key.reshape(1))
            for at in (bucket[0], self._other(bucket, prints)[0]):
                found = np.flatnonzero(self.slots[at] == prints[0])
                if len(found):
                    self.slots[at, found[0]] = 0
                    self.keys -= 1
                    break

    def dump(self) -> bytes:
        return np.int64(self.keys).tobytes() + self.slots.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16, offset=8).reshape(-1, SLOTS).copy()
        return cls(len(slots), slots, int(np.frombuffer(data, np.int64, 1)[0]))


def keys_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


ROWS = "row long, doc_id long, digest binary, shard int"
ENTRY = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("doc_id", pa.int64()),
                   ("row", pa.int64()), ("n", pa.int64()), ("filter", pa.binary())])
ENTRIES = "shard int, digest binary, doc_id long, row long, n long, filter binary"


def digest_rows(docs: DataFrame, shards: int) -> DataFrame:
    """``(row, doc_id, digest, shard)`` of every row: SHA-256 of the text, A-Z lower-cased.

    A NULL text counts as empty. ``row`` only tells rows apart; write the table before use.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        digest.alias("digest"),
    ).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def _better(a: list, b: tuple) -> None:
    """Adds what ``b`` (doc_id, row, n) counts to ``a`` and keeps the row with the larger id."""
    x, y = (a[0] is not None, a[0], a[1]), (b[0] is not None, b[0], b[1])
    if (x[0], x[1] or 0, x[2]) < (y[0], y[1] or 0, y[2]):
        a[0], a[1] = b[0], b[1]
    a[2] += b[2]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(ENTRY)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ENTRY)], schema=ENTRY)


def summed_up(rows: DataFrame) -> DataFrame:
    """Entries ``(shard, digest, doc_id, row, n)``: equal digests of a task are one entry.

    ``doc_id`` and ``row`` are those of the row with the largest id. A digest that very many
    rows have thus reaches its shard about once per task.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        of: dict[bytes, int] = {}

        def out():
            yield from _table([(of[d], d, *x, None) for d, x in held.items()]).to_batches()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("digest", "shard", "doc_id", "row")]
            for digest, shard, doc_id, row in zip(*columns):
                known = held.get(digest)
                if known is None:
                    held[digest], of[digest] = [doc_id, row, 1], shard
                else:
                    _better(known, (doc_id, row, 1))
            if len(held) >= HELD:
                yield from out()
                held.clear()
                of.clear()
        yield from out()

    return rows.mapInArrow(add, ENTRIES)


def _entries(rows: pa.Table) -> tuple[bytes | None, list, list[bytes], list[tuple]]:
    """A shard's filter, its number, and the digests and values of its entries."""
    columns = {c: rows[c].to_pylist() for c in ENTRY.names}
    stored = next((f for f in columns["filter"] if f is not None), None)
    held = [k for k, d in enumerate(columns["digest"]) if d is not None]
    digests = [columns["digest"][k] for k in held]
    values = [(columns["doc_id"][k], columns["row"][k], columns["n"][k]) for k in held]
    return stored, columns["shard"][0], digests, values


def _probe(rows: pa.Table) -> pa.Table:
    """The entries of a shard that its filter seems to know are marked by an empty ``filter``."""
    stored, shard, digests, values = _entries(rows)
    hit = [False] * len(digests)
    if stored is not None and digests:
        hit = CuckooFilter.load(stored).contains(keys_of(digests)).tolist()
    return _table([(shard, d, *v, b"" if h else None) for d, v, h in zip(digests, values, hit)])


def _insert(rows: pa.Table) -> pa.Table:
    """New digests of a shard, each once, and a row with the shard's filter.

    The entries come from several tasks, so a digest may come again: the filter says which were
    not seen before, and its hits are verified in the shard's digests of this batch. A filter
    that overflows is resized from them; if it held older digests as well, an empty filter is
    given, and the caller sizes it from the stored ones.
    """
    stored, shard, digests, values = _entries(rows)
    live = CuckooFilter.load(stored) if stored else CuckooFilter.sized(len(set(digests)))
    older, failed = live.keys, False
    content: dict[bytes, list] = {}
    for start in range(0, len(digests), CHUNK):
        part, new = digests[start : start + CHUNK], {}
        hits = live.contains(keys_of(part)).tolist()
        for digest, value, hit in zip(part, values[start:], hits):
            known = (content.get(digest) if hit or failed else None) or new.get(digest)
            if known is None:
                new[digest] = list(value)
            else:
                _better(known, value)
        content |= new
        if not failed and new and not live.insert(keys_of(list(new))):
            failed = older > 0
            if not failed:
                live = CuckooFilter.of(keys_of(list(content)), 2 * live.keys)
    out = [(shard, d, *v, None) for d, v in content.items()]
    return _table(out + [(shard, None, None, None, live.keys, b"" if failed else live.dump())])


def _build(rows: pa.Table) -> pa.Table:
    _, shard, digests, values = _entries(rows)
    live = CuckooFilter.of(keys_of(digests), values[0][2])
    return _table([(shard, None, None, None, live.keys, live.dump())])


def _remove(rows: pa.Table) -> pa.Table:
    stored, shard, digests, _ = _entries(rows)
    live = CuckooFilter.load(stored)
    live.delete(keys_of(digests))
    return _table([(shard, None, None, None, live.keys, live.dump())])


def _per_shard(call, *parts: DataFrame) -> DataFrame:
    rows = parts[0].select(*ENTRY.names)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*ENTRY.names))
    return rows.groupBy("shard").applyInArrow(call, ENTRIES)


def _as_entries(df: DataFrame, n: str = "CAST(NULL AS LONG)") -> DataFrame:
    """``df (shard, digest)`` with the other columns of entries."""
    return df.selectExpr("shard", "digest", "CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS LONG) AS row",
                         f"{n} AS n", "CAST(NULL AS BINARY) AS filter")


@dataclass(frozen=True)
class Index:
    """Live digests: a filter per shard, and all live rows ``(row, doc_id, digest, shard)``."""

    shards: int
    filters: DataFrame
    rows: DataFrame

    def save(self, path: str) -> None:
        """Writes the index below ``path``, the rows in order of shard and digest."""
        self.filters.withColumn("shards", F.lit(self.shards)).write.parquet(f"{path}/filters")
        ordered = self.rows.repartitionByRange("shard", "digest", "row").sortWithinPartitions("shard", "digest")
        ordered.write.parquet(f"{path}/rows")


def empty_index(spark: SparkSession, rows: int) -> Index:
    """An index for about ``rows`` rows; more are taken as well, in larger shards."""
    shards = max(LEAST_SHARDS, -(-rows // SHARD_ROWS))
    return Index(shards, spark.createDataFrame([], ENTRIES), spark.createDataFrame([], ROWS))


def load_index(spark: SparkSession, path: str) -> Index:
    filters = spark.read.parquet(f"{path}/filters")
    shards = filters.select("shards").first()
    return Index(shards[0] if shards else LEAST_SHARDS, filters.drop("shards"),
                 spark.read.parquet(f"{path}/rows"))


def _known(index: Index, entries: DataFrame) -> DataFrame:
    """Stored digests among ``entries``: the filters pick, the stored rows verify."""
    hits = _per_shard(_probe, entries, index.filters).where(F.col("filter").isNotNull())
    hits = hits.select("shard", "digest").distinct()
    return cut(index.rows.join(hits, ["shard", "digest"], "left_semi").groupBy("shard", "digest").agg(
        F.max("doc_id").alias("stored_id"), F.count(F.lit(1)).alias("stored")), "known")


def insert(index: Index, docs: DataFrame) -> tuple[Index, DataFrame]:
    """The index with the rows of ``docs (doc_id, text)`` added, and what became of each row.

    Decisions: ``doc_id, keep_id, group_size, kept, digest``. Of equal texts, the row with the
    largest id stays; of rows that share that id, a stored one, or any one of the new. Ids that
    are NULL are the smallest, a NULL text counts as empty, repeated rows are rows of their group.
    Texts may be of any length; only their digests move. Other columns, whatever their names, are
    not looked at. An empty table gives no rows and the same index.
    """
    first = index.rows.isEmpty()
    rows = cut(digest_rows(docs, index.shards), "digests")
    entries = summed_up(rows)
    filters = index.filters
    if first:
        settled = cut(_per_shard(_insert, entries), "settled")
    else:
        entries = cut(entries, "entries")
        known = _known(index, entries)
        fresh = cut(entries.join(known, ["shard", "digest"], "left_anti").select(*ENTRY.names), "fresh")
        more = fresh.groupBy("shard").agg(F.count(F.lit(1)).alias("more"))
        room = F.expr(f"floor((length(filter) - 8) / 2 * {FULL}) - n")
        tight = filters.join(more, "shard").where(F.col("more") > room).selectExpr("shard", "2 * (n + more) AS least")
        while True:
            tight = cut(tight, "tight")
            if not tight.isEmpty():  # overflow: new filters from the stored digests
                live = index.rows.join(tight, "shard").groupBy("shard", "digest").agg(F.max("least").alias("least"))
                larger = _per_shard(_build, _as_entries(live, "least"))
                filters = cut(filters.join(tight, "shard", "left_anti").select(*ENTRY.names).unionByName(larger), "filters")
            settled = cut(_per_shard(_insert, fresh, filters), "settled")
            tight = settled.where("digest IS NULL AND length(filter) = 0").selectExpr("shard", "4 * n + 64 AS least")
            if tight.isEmpty():
                break
    filters = settled.where("digest IS NULL")
    groups = settled.where("digest IS NOT NULL").select("digest", "doc_id", "row", "n")
    if not first:
        again = entries.join(known, ["shard", "digest"]).groupBy("digest", "stored_id", "stored").agg(
            F.max(F.struct("doc_id", "row")).alias("best"), F.sum("n").alias("n"))
        newer = F.expr("best.doc_id IS NOT NULL AND (stored_id IS NULL OR best.doc_id > stored_id)")
        groups = groups.unionByName(again.select(
            "digest", F.when(newer, F.col("best.doc_id")).otherwise(F.col("stored_id")).alias("doc_id"),
            F.when(newer, F.col("best.row")).alias("row"), (F.col("n") + F.col("stored")).alias("n")))
    # A digest with one row needs no join: that row is the group.
    shared = groups.where("n > 1").select("digest", F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n")
    out = rows.join(shared, "digest", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.coalesce(F.col("row") == F.col("_row"), F.lit(False))).alias("kept"),
        "digest",
    )
    return Index(index.shards, filters, rows if first else index.rows.unionByName(rows)), out


def delete(index: Index, docs: DataFrame) -> Index:
    """The index without the rows that have the id and the text of a row of ``docs``.

    All rows of such an id and text go. Rows that are not in the index change nothing. A digest
    that loses its last row leaves its filter.
    """
    gone = digest_rows(docs, index.shards).select("digest", "doc_id").distinct()
    same = index.rows["digest"].eqNullSafe(gone["digest"]) & index.rows["doc_id"].eqNullSafe(gone["doc_id"])
    rows = cut(index.rows.join(gone, same, "left_anti"), "rows")
    hit = index.rows.join(gone, same, "left_semi").select("shard", "digest").distinct()
    dead = hit.join(rows, ["shard", "digest"], "left_anti")
    dead = cut(_as_entries(dead), "dead")
    touched = dead.select("shard").distinct()
    changed = _per_shard(_remove, dead, index.filters.join(touched, "shard", "left_semi"))
    filters = cut(index.filters.join(touched, "shard", "left_anti").select(*ENTRY.names).unionByName(changed), "filters")
    return replace(index, filters=filters, rows=rows)


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """``docs`` with ``keep_id`` and ``group_size`` of their text in the index; 0 if not in it.

    Names that ``docs`` has already get a leading ``_``.
    """
    keep, size, digest = unused(docs, "keep_id", "group_size", "digest")
    asked = digest_rows(docs.select("text", F.lit(None).cast("long").alias("doc_id")), index.shards)
    known = _known(index, summed_up(asked)).select(
        F.col("digest").alias(digest), F.col("stored_id").alias(keep), F.col("stored").alias(size))
    text = F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, LOWER)
    out = docs.withColumn(digest, F.unhex(F.sha2(text.cast("binary"), 256))).join(known, digest, "left")
    return out.select(*[docs[c] for c in docs.columns], keep, F.coalesce(size, F.lit(0)).alias(size))


SQL = f"""
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
    SELECT doc_id, keep_id, group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
    FROM d JOIN g USING (text_sha256)"""


@query("op13_cuckoo_dedup", SQL)
def op13_cuckoo_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    _, out = insert(empty_index(spark, docs.count()), docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
