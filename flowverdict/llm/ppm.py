"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is its words (A-Z lower-cased) joined by one space, then an end byte. The byte-context
trie of order ``ORDER`` is held as sorted arrays of byte n-grams with their counts over all
training texts; shorter contexts follow from longer ones by summing. A byte is coded in the
longest context in which it was seen; each longer one costs an escape (method C: as likely as
the context has different bytes), and the bytes seen there are excluded from the shorter one.
The bytes seen after a context were all seen after its suffixes, so what has to be excluded
depends only on the context one byte longer, and is prepared for each once.

A table of more than ``MOST_GRAMS`` n-grams is not sent whole: the most frequent ones go to all
tasks with their probabilities, the others of each text are resolved by joins with the written
tables of all orders. Both ways give the same scores.

Beside it goes a unigram score over words. Its counts cover all training words; the most
frequent ones go to all tasks, the rest is joined.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as w
from .common import cut, give_back, is_held_out, learnt_from, table
from .registry import query

MODULUS, HELD_OUT = 5, 1
ORDER = 5
END = 10  # a byte that no word holds
# n-grams that go to every task: all of them, or of a larger table the most frequent ones, the
# others being joined.
MOST_GRAMS = 6_000_000
HOT_GRAMS = 10_000  # of the joined n-grams, those found in most texts are sent after all
HEAD_WORDS = 1 << 18
FLUSH = 6 << 20
END_WORD = -1  # stands for the end in the table of words
U64 = np.uint64
EVERY_BYTE = 256


def normal(texts: list[bytes]) -> np.ndarray:
    """The coded bytes of ``texts``, each after ``ORDER`` end bytes and closed by one."""
    lead = bytes([END]) * ORDER
    return np.frombuffer(b"".join(
        part for t in texts for part in (lead, b" ".join(t.lower().split()), bytes([END]))), np.uint8)


def grams(coded: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The ``order + 1`` bytes up to each place, packed into one number."""
    out = np.zeros(max(0, len(coded) - order), U64)
    for k in range(order + 1):
        out <<= U64(8)
        out |= coded[k : k + len(out)]
    return out


def coded_places(texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Indices into ``grams`` of the bytes that are coded (not the leading end bytes)."""
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([np.arange(s, s + n - ORDER) for s, n in zip(starts, sizes)]) if texts else np.empty(0, int)


class Table:
    """Looks up 64-bit keys in an open-addressing table, many at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left = np.arange(len(keys), dtype=np.int32)
        at = self._place(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key, -1 where it is missing."""
        out = self.slots[self._place(keys)]
        if not len(self.keys):
            return out
        left = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = self._place(keys[left])
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at]
            more = (out[left] >= 0) & (self.keys[out[left]] != keys[left])
            left, at = left[more], at[more]
        return out


class Trie:
    """Counts of all orders, and what is left of a context after exclusion."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """``keys``: packed n-grams of ``ORDER + 1`` bytes, each once."""
        self.contexts, self.total, self.kinds = [], [], []
        self.rest_total, self.rest_kinds = [None], [None]
        counts = counts.astype(np.float64, copy=False)
        if np.any(keys[1:] < keys[:-1]):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
        self.grams, self.counts = [keys], [counts]
        for order in range(ORDER - 1, -1, -1):
            low = self.grams[0] & U64((1 << 8 * (order + 1)) - 1)
            low, inverse = np.unique(low, return_inverse=True)
            self.counts.insert(0, np.bincount(inverse, self.counts[0], len(low)))
            self.grams.insert(0, low)
        for order in range(ORDER + 1):
            context, inverse = np.unique(self.grams[order] >> U64(8), return_inverse=True)
            self.contexts.append(context)
            self.total.append(np.bincount(inverse, self.counts[order], len(context)))
            self.kinds.append(np.bincount(inverse, minlength=len(context)).astype(np.float64))
            if order:
                # Of the suffix context, what the bytes seen after this one leave.
                mask = U64((1 << 8 * order) - 1)
                seen = self.counts[order - 1][np.searchsorted(self.grams[order - 1], self.grams[order] & mask)]
                suffix = np.searchsorted(self.contexts[order - 1], context & (mask >> U64(8)))
                self.rest_total.append(self.total[order - 1][suffix] - np.bincount(inverse, seen, len(context)))
                self.rest_kinds.append(self.kinds[order - 1][suffix] - self.kinds[order])
        of = np.searchsorted(self.contexts[ORDER], self.grams[ORDER] >> U64(8))
        self.direct = np.log10(self.counts[ORDER] / (self.total[ORDER][of] + self.kinds[ORDER][of]))
        self.top = Table(self.grams[ORDER])

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of every packed n-gram after the bytes before it."""
        at = self.top.find(keys)
        out = np.zeros(len(keys))
        known = at >= 0
        out[known] = self.direct[at[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            distinct, inverse = np.unique(keys[missing], return_inverse=True)
            out[missing] = self._escaped(distinct)[inverse]
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        above = np.full(len(keys), -1)  # the seen context one byte longer
        for order in range(ORDER, -1, -1):
            low = keys & U64((1 << 8 * (order + 1)) - 1)
            at, of = _find(self.grams[order], low), _find(self.contexts[order], low >> U64(8))
            seen = of >= 0
            total = np.where(seen, self.total[order][of], 0.0) if len(self.total[order]) else np.zeros(len(keys))
            kinds = np.where(seen, self.kinds[order][of], 0.0) if len(self.kinds[order]) else np.zeros(len(keys))
            if order < ORDER and len(self.rest_total[order + 1]):
                less = above >= 0
                total = np.where(less, self.rest_total[order + 1][above], total)
                kinds = np.where(less, self.rest_kinds[order + 1][above], kinds)
            room = total + kinds
            hit = open_ & (at >= 0)
            out[hit] += np.log10(self.counts[order][at[hit]] / room[hit])
            open_ &= at < 0
            escape = open_ & (room > 0)
            out[escape] += np.log10(kinds[escape] / room[escape])
            above = of
        unseen = EVERY_BYTE - (self.kinds[0][0] if len(self.kinds[0]) else 0.0)
        out[open_] -= np.log10(unseen)
        return out

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """log10 probability of each text, its end included; no n-gram is left to join."""
        keys, first, last = _spans(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.log10(keys))])
        return sums[last] - sums[first], [np.empty(0, np.int64)] * len(texts), [np.empty(0, np.int64)] * len(texts)


class Frequent:
    """The most frequent n-grams with the log10 probabilities of their last bytes."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.top, self.logs = Table(keys), logs

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The part of each text that is known here; its other n-grams and how often each comes."""
        keys, first, last = _spans(texts)
        at = self.top.find(keys)
        known = np.where(at >= 0, self.logs[at], 0.0) if len(self.logs) else np.zeros(len(keys))
        sums = np.concatenate([[0.0], np.cumsum(known)])
        left, times = [], []
        for a, b in zip(first, last):
            k, n = np.unique(keys[a:b][at[a:b] < 0], return_counts=True)
            left.append(k.view(np.int64))
            times.append(n)
        return sums[last] - sums[first], left, times


def _spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of ``texts``, and where those of each text begin and end."""
    coded = normal(texts)
    ends = np.flatnonzero(coded == END)
    # Every text has ORDER leading ends and one that closes it.
    return grams(coded), ends[0 :: ORDER + 1], ends[ORDER :: ORDER + 1] - ORDER + 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(word, key, n)``: counts of all words and of all byte n-grams of the training texts.

    Every task counts by sorting and sends each key once a flush, so a very frequent key costs
    one row a flush.
    """

    trained = docs.where(learnt_from(F.col("doc_id"), MODULUS, HELD_OUT)).select("text")
    return trained.mapInArrow(_count, "word boolean, key long, n long").groupBy("word", "key").agg(
        F.sum("n").alias("n"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # A worker may still hold the trie of an earlier corpus.
    if _tries:
        _tries.clear()
        give_back()
    for batch in batches:
        for _, texts in w.batches_of(batch.column("text"), FLUSH):
            coded = normal(texts)
            found = grams(coded)
            # n-grams that end in the lead of the next text belong to no text.
            lead = np.zeros(len(coded), bool)
            ends = np.flatnonzero(coded == END)
            for k in range(ORDER):
                lead[ends[k :: ORDER + 1]] = True
            keys, n = np.unique(found[~lead[ORDER:]], return_counts=True)
            yield _counted(False, keys, n)
            hashes, _ = w.words(texts)
            keys, n = np.unique(hashes >> U64(1), return_counts=True)
            yield _counted(True, keys, n)
            yield _counted(True, np.array([END_WORD]).view(U64), np.array([len(texts)]))


def _counted(word: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(np.full(len(keys), word)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))],
        ["word", "key", "n"])


def _low(key: str, order: int):
    """The last ``order + 1`` bytes of a packed n-gram."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1).cast("long"))


def _context(key: str):
    return F.shiftright(key, 8)


class Orders:
    """Counts of all orders as written tables. A key meets at most 256 rows in every join.

    ``grams[k]``: ``(key, n)``, ``k + 1`` bytes each. ``contexts[k]``: ``(context, total, kinds,
    rest_total, rest_kinds)``, ``rest_*`` as in ``Trie``.
    """

    def __init__(self, found: DataFrame):
        self.grams = [found.select("key", "n")]
        for order in range(ORDER - 1, -1, -1):
            self.grams.insert(0, cut(self.grams[0].groupBy(_low("key", order).alias("key")).agg(
                F.sum("n").alias("n")), "grams"))
        nothing = F.lit(None).cast("long")
        of = self.grams[0].groupBy(_context("key").alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        self.contexts = [cut(of.select(
            "*", nothing.alias("rest_total"), nothing.alias("rest_kinds")), "contexts")]
        for order in range(1, ORDER + 1):
            shorter = self.grams[order - 1].select(F.col("key").alias("low"), F.col("n").alias("seen"))
            suffixes = self.contexts[order - 1].select(
                F.col("context").alias("suffix"), F.col("total").alias("of_total"), F.col("kinds").alias("of_kinds"))
            of = self.grams[order].withColumn("low", _low("key", order - 1)).join(shorter, "low").groupBy(
                _context("key").alias("context")).agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("seen").alias("seen"))
            self.contexts.append(cut(of.withColumn("suffix", _low("context", order - 2)).join(
                suffixes, "suffix").select(
                "context", "total", "kinds", (F.col("of_total") - F.col("seen")).alias("rest_total"),
                (F.col("of_kinds") - F.col("kinds")).alias("rest_kinds")), "contexts"))
        kinds = self.contexts[0].agg(F.sum("kinds")).first()[0] or 0
        self.unseen = -float(np.log10(EVERY_BYTE - kinds)) if kinds < EVERY_BYTE else 0.0

    def frequent(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``most`` n-grams, none of them rarer than one left out, and their log10
        probabilities."""
        of_n = self.grams[ORDER].groupBy("n").agg(F.count(F.lit(1)).alias("key"))
        kinds, n = _columns(of_n)
        order = np.argsort(-n)
        fit = int(np.searchsorted(np.cumsum(kinds[order]), most, "right"))
        if not fit:
            return np.empty(0, U64), np.empty(0)
        found = self.grams[ORDER].where(F.col("n") >= int(n[order[fit - 1]]))
        keys, logs = _columns(found.withColumn("context", _context("key")).join(
            self.contexts[ORDER].select("context", "total", "kinds"), "context").select(
            "key", (F.log10("n") - F.log10(F.col("total") + F.col("kinds"))).alias("n")))
        return keys.view(U64), logs

    def log10(self, wanted: DataFrame) -> DataFrame:
        """``(key, log10)`` of distinct packed n-grams ``wanted (key)``, seen or not.

        From the shortest context up: ``n`` is the count, ``free`` the value where the context
        one byte longer was not seen, ``less`` the value after an escape from the context itself,
        whose bytes are then excluded.
        """
        asked = [wanted.select("key")]
        for order in range(ORDER - 1, -1, -1):
            asked.insert(0, cut(asked[0].select(_low("key", order).alias("key")).distinct(), "asked"))
        state = None
        for order in range(ORDER + 1):
            rows = asked[order].join(self.grams[order], "key", "left").withColumn(
                "context", _context("key")).join(self.contexts[order], "context", "left")
            if state is None:
                less = free = F.lit(self.unseen)
            else:
                rows = rows.withColumn("low", _low("key", order - 1)).join(state.select(
                    F.col("key").alias("low"), F.col("n").alias("low_n"), F.col("free").alias("low_free"),
                    F.col("less").alias("low_less")), "low")
                room = F.log10(F.col("rest_total") + F.col("rest_kinds"))
                # Where all bytes are excluded there is no escape to code.
                less = F.when(F.col("low_n") > 0, F.log10("low_n") - room).otherwise(
                    F.coalesce(F.log10("rest_kinds") - room, F.lit(0.0)) + F.col("low_less"))
                free = F.col("low_free")
            room = F.log10(F.col("total") + F.col("kinds"))
            state = cut(rows.select(
                "key", "n", less.alias("less"),
                F.when(F.col("n") > 0, F.log10("n") - room)
                .when(F.col("total") > 0, F.log10("kinds") - room + less).otherwise(free).alias("free")), "state")
        return state.select("key", F.col("free").alias("log10"))


def _joined_scores(rows: DataFrame, orders: Orders) -> DataFrame:
    """``(high, low, joined_score)``: of the n-grams that were not among the frequent ones."""
    left = rows.select("high", "low", F.explode(F.arrays_zip("left", "left_times")).alias("x")).select(
        "high", "low", F.col("x.left").alias("key"), F.col("x.left_times").alias("times"))
    wanted = cut(left.groupBy("key").agg(F.count(F.lit(1)).alias("texts")), "wanted")
    values = cut(wanted.join(orders.log10(wanted), "key"), "values")
    # Sent, so that no task of the join gets the rows of an n-gram that is new in very many texts.
    hot = values.orderBy(F.desc("texts"), "key").limit(HOT_GRAMS).select("key", F.col("log10").alias("sent"))
    met = left.join(F.broadcast(hot), "key", "left")
    parts = met.where("sent IS NOT NULL").select("high", "low", (F.col("times") * F.col("sent")).alias("part")).unionByName(
        met.where("sent IS NULL").join(values, "key").select(
            "high", "low", (F.col("times") * F.col("log10")).alias("part")))
    return parts.groupBy("high", "low").agg(F.sum("part").alias("joined_score"))


def _columns(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(key, n)`` of a bounded table as arrays; Arrow keeps it small on the way."""
    found = counts.select("key", "n").toArrow()
    return found["key"].to_numpy(), found["n"].to_numpy()


_tries: dict[int, tuple] = {}


def _ready(shared) -> tuple:
    """Trie or frequent n-grams, and frequent words, of a broadcast, built once in a worker."""
    if shared.value["name"] not in _tries:
        _tries.clear()
        give_back()
        v = shared.value
        model = Trie(v["grams"], v["counts"]) if v["whole"] else Frequent(v["grams"], v["counts"])
        _tries[v["name"]] = (model, Table(v["words"].view(U64)), v["word_counts"])
        give_back()  # what building took besides
    return _tries[shared.value["name"]]


MAIN = ("doc_id long, n_tokens long, high long, low long, head_sum double, head_known long, "
        "score double, rare array<long>, times array<long>, left array<long>, left_times array<long>")


def _score(shared):
    """One row per document; words and n-grams that are not among the frequent ones are passed on."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, head, head_counts = _ready(shared)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for first, texts in w.batches_of(batch.column("text"), FLUSH // 3):
                hashes, at = w.words(texts)
                keys = hashes >> U64(1)
                found = head.find(keys)
                logs = np.where(found >= 0, np.log10(head_counts[found] + 0.5), 0.0) if len(head_counts) else np.zeros(len(keys))
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                known = np.concatenate([[0], np.cumsum(found >= 0)])
                rare, times = [], []
                for a, b in zip(at[:-1], at[1:]):
                    k, n = np.unique(keys[a:b][found[a:b] < 0], return_counts=True)
                    rare.append(k.view(np.int64))
                    times.append(n)
                names = np.frombuffer(b"".join(
                    hashlib.blake2b(t, digest_size=16).digest() for t in texts), "<i8").reshape(-1, 2)
                score, left, left_times = trie.texts(texts)
                yield pa.record_batch([
                    ids.slice(first, len(texts)), pa.array(np.diff(at) + 1),
                    pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])),
                    pa.array(sums[at[1:]] - sums[at[:-1]]), pa.array(known[at[1:]] - known[at[:-1]]),
                    pa.array(score), *[pa.array(x, pa.list_(pa.int64())) for x in (rare, times, left, left_times)]],
                    ["doc_id", "n_tokens", "high", "low", "head_sum", "head_known", "score", "rare", "times",
                     "left", "left_times"])

    return score


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every row of ``docs (doc_id, text)`` by the model of its training rows.

    ``score`` is the log10 probability of the whole text under the trie, ``base_score`` the
    smoothed unigram score of its words and end. A NULL text is an empty one: only its end is
    scored. Rows whose id is NULL count as id ''. Repeated rows each give a row and each count
    in the training. Without training rows every byte is equally likely.
    """
    spark = docs.sparkSession
    counts = cut(corpus_counts(docs), "counts")
    words = counts.where("word").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end_count = (words.where(F.col("key") == END_WORD).agg(F.sum("n")).first()[0]) or 0
    head, head_counts = _columns(
        words.where(F.col("key") != END_WORD).orderBy(F.desc("n"), "key").limit(HEAD_WORDS))
    found = counts.where("NOT word").select("key", "n")
    orders = None if found.count() <= MOST_GRAMS else Orders(found)
    if orders is None:
        keys, n = _columns(found)
        order = np.argsort(keys)
        keys, n = keys[order].view(U64), n[order].astype(np.float64)
    else:
        keys, n = orders.frequent(MOST_GRAMS)
    shared = spark.sparkContext.broadcast({
        "name": uuid.uuid4().hex, "whole": orders is None, "grams": keys, "counts": n,
        "words": head, "word_counts": head_counts.astype(np.float64)})
    del head, keys, n
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _score(shared), MAIN), "scores")
    names = ["high", "low"]
    rare = rows.select(*names, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        *names, F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    joined = rare.join(words, "key", "left").groupBy(*names).agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_sum"),
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"))
    # Equal texts share a name, so their sums came up once for each of them.
    copies = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    sums = copies.join(joined, names, "left")
    if orders is None:
        sums = sums.withColumn("joined_score", F.lit(0.0))
    else:
        sums = sums.join(_joined_scores(rows, orders), names, "left")
    sums = cut(sums, "sums")
    held_out = is_held_out(F.col("doc_id"), MODULUS, HELD_OUT)
    space = float(np.log10(total + 0.5 * (distinct + 1)))
    of_end = float(np.log10(end_count + 0.5))
    rare_sum = F.coalesce(F.col("rare_sum") / F.col("copies"), F.lit(0.0))
    rare_known = F.coalesce((F.col("rare_known") / F.col("copies")), F.lit(0.0)).cast("long")
    return rows.join(sums, names).select(
        "doc_id", held_out.alias("held_out"), "n_tokens",
        (F.col("head_known") + rare_known + int(end_count > 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_sum") + rare_sum + of_end - F.col("n_tokens") * space).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("joined_score") / F.col("copies"), F.lit(0.0))).alias("score"))


@query("op8_ppm_scoring")
def op8_ppm_scoring(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents"))
