"""Spelling variants of a vocabulary, found by probing edits against Bloom filters.

Words are counted over all texts. For each length, blocked Bloom filters hold the words of that
length, in shards of bounded size; they are sent to the tasks in passes of bounded size. A task
makes the edits of its words as hashes (the hash of an edit follows from that of the word in a
few steps, so no text is built) and probes them. Only positives become texts, and are joined with
the vocabulary, which drops the false ones. Every pair is found from one side: the longer word
deletes, and of two equally long words the smaller one replaces a letter by a larger.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, table
from .registry import query
from .words import mixed, powers, texts_of

LEAST_LENGTH, LEAST_COUNT, LOST_EVERY = 5, 3, 97
HELD = 200_000  # distinct words a task counts before it hands them on
BITS, MARKS = 20, 5  # of a filter: bits per word, and how many of them a word sets
FILTER_WORDS = 1 << 20  # words of a filter
PASS_BYTES = 32 << 20  # filters sent at a time
LONG = 64  # words from this length on share their filters, which hardly ever err:
LONG_BITS, LONG_MARKS = 128, 10  # such words have very many edits, and each is a long text
PART_WORDS = 8192  # words of a task that probes
CELLS = 1 << 18  # letters edited at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, lost_every: int | None = LOST_EVERY) -> DataFrame:
    """``(word, n)``: occurrences of all words of at least ``least`` code points.

    A word is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where ``lost_every``
    divides the CRC-32 of ``<doc_id>:<word>``, the word loses one code point, at the place the
    CRC gives modulo its length. A NULL text has no words, a NULL id counts as ''.
    """
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)  # U+00C0-U+00FF in UTF-8

    def out(held: Counter) -> pa.RecordBatch:
        words = [w.decode() for w in held]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                mine = Counter(run.findall(text.lower()))
                if lost_every:
                    before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                    lost = [w for w in mine if zlib.crc32(w, before) % lost_every == 0]
                    for word in lost:
                        letters = word.decode()
                        at = zlib.crc32(word, before) % len(letters)
                        n = mine.pop(word)
                        if len(letters) > least:
                            held[(letters[:at] + letters[at + 1 :]).encode()] += n
                held.update(mine)
                if len(held) >= HELD:
                    yield out(held)
                    held.clear()
        yield out(held)

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT, **words) -> DataFrame:
    """``(word, n, size)`` of the words with at least ``least_count`` occurrences."""
    counted = word_counts(docs, **words).where(F.col("n") >= least_count)
    return counted.withColumn("size", F.length("word"))


def letters_of(words: pa.Array, size: int) -> np.ndarray:
    """Code points of equally long words, a row each. All letters are below U+0100."""
    text = "".join(words.to_pylist())
    return np.frombuffer(text.encode("latin-1"), np.uint8).reshape(-1, size)


def _sums(letters: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, the empty one first."""
    out = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    np.cumsum(letters.astype(np.uint64) * powers(BASE, letters.shape[1]), axis=1, out=out[:, 1:])
    return out


def finished(sums: np.ndarray, size: int) -> np.ndarray:
    return mixed(sums ^ mixed(np.full(1, size, np.uint64)))


class Filter:
    """Blocked Bloom filter: a block is one 64-bit word, a key sets ``marks`` bits of its block."""

    def __init__(self, blocks: np.ndarray, marks: int):
        self.blocks, self.marks = blocks, marks

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for k in range(self.marks):
            out |= np.uint64(1) << ((keys >> np.uint64(6 * k)) & np.uint64(63))
        return out

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) % np.uint64(len(self.blocks))).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, kind: int) -> Filter:
        bits, marks = (LONG_BITS, LONG_MARKS) if kind == LONG else (BITS, MARKS)
        out = cls(np.zeros(max(1, -(-len(keys) * bits // 64)), np.uint64), marks)
        np.bitwise_or.at(out.blocks, out._places(keys), out._bits(keys))
        return out

    @classmethod
    def load(cls, blocks: bytes, kind: int) -> Filter:
        return cls(np.frombuffer(blocks, np.uint64), LONG_MARKS if kind == LONG else MARKS)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """False: certainly not among the keys."""
        bits = self._bits(keys)
        return (self.blocks[self._places(keys)] & bits) == bits


class Filters:
    """Filters of some (length class, shard); ``shards``: of every class."""

    def __init__(self, shards: dict[int, int], parts: dict[tuple[int, int], Filter]):
        self.shards, self.parts = shards, parts

    def serves(self, size: int) -> bool:
        return any(kind == min(size, LONG) for kind, _ in self.parts)

    def has(self, keys: np.ndarray, size: int) -> np.ndarray:
        kind = min(size, LONG)
        mine = [(s, f) for (k, s), f in self.parts.items() if k == kind]
        if self.shards.get(kind) == 1:
            return mine[0][1].has(keys)
        shard, out = shard_of(keys, self.shards[kind]), np.zeros(len(keys), bool)
        for s, f in mine:
            at = np.flatnonzero(shard == s)
            out[at] = f.has(keys[at])
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(~keys) % np.uint64(shards)).astype(np.int64)


def edits(
    letters: np.ndarray, alphabet: np.ndarray, filters: Filters
) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Edits of the words ``letters`` (a row each) that the filters seem to know.

    Gives rows, places in them, and the letter that comes there; None: the one there goes.
    """
    size = letters.shape[1]
    sums = _sums(letters)
    if size > 1 and filters.serves(size - 1):
        found = sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * BACK
        # Of a run of equal letters only the first is deleted: the others give the same word.
        new = np.ones(letters.shape, bool)
        new[:, 1:] = letters[:, 1:] != letters[:, :-1]
        rows, places = np.nonzero(new)
        hit = filters.has(finished(found[rows, places], size - 1), size - 1)
        yield rows[hit], places[hit], None
    if filters.serves(size):
        steps = powers(BASE, size)
        for letter in alphabet.tolist():
            rows, places = np.nonzero(letters < letter)
            more = np.uint64(letter) - letters[rows, places].astype(np.uint64)
            hit = filters.has(finished(sums[rows, -1] + more * steps[places], size), size)
            yield rows[hit], places[hit], letter


def edited(letters: np.ndarray, places: np.ndarray, letter: int | None) -> list[str]:
    """The words ``letters`` with the letter at ``places`` replaced, or deleted."""
    n, size = letters.shape
    if letter is None:
        keep = np.ones((n, size), bool)
        keep[np.arange(n), places] = False
        letters, size = letters[keep], size - 1
    else:
        letters = letters.copy()
        letters[np.arange(n), places] = letter
    text = letters.tobytes().decode("latin-1")
    return [text[k : k + size] for k in range(0, n * size, size)]


def _shards(vocab: DataFrame) -> dict[int, int]:
    """Shards of every length class; at most ``LONG`` classes."""
    kind = F.least("size", F.lit(LONG)).alias("kind")
    return {r["kind"]: -(-r["count"] // FILTER_WORDS) for r in vocab.groupBy(kind).count().collect()}


def _with_shard(vocab: DataFrame, shards: dict[int, int]) -> DataFrame:
    """``(kind, shard, keys)``: hashed words in pieces, the keys as bytes."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, rows in by_size(batch.column("size")):
                for piece in pieces(rows, size):
                    keys = finished(_sums(letters_of(batch.column("word").take(pa.array(piece)), size))[:, -1], size)
                    kind = min(size, LONG)
                    shard = shard_of(keys, shards[kind])
                    out += [(kind, s, keys[shard == s].tobytes()) for s in np.unique(shard).tolist()]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))],
                ["kind", "shard", "keys"])

    return vocab.select("word", "size").mapInArrow(keyed, "kind int, shard int, keys binary")


def by_size(sizes: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of every length."""
    sizes = sizes.to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    found, first = np.unique(sizes[order], return_index=True)
    for size, rows in zip(found.tolist(), np.split(order, first[1:])):
        yield size, rows


def pieces(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(size, 1))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def _filter(rows: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.uint64)
    return pa.table({"kind": rows["kind"][:1].cast(pa.int32()), "shard": rows["shard"][:1].cast(pa.int32()),
                     "blocks": pa.array([Filter.of(keys, rows["kind"][0].as_py()).blocks.tobytes()], pa.binary())})


def filter_table(vocab: DataFrame, shards: dict[int, int]) -> DataFrame:
    """``(kind, shard, blocks)``: a Bloom filter for each shard of each length class."""
    return _with_shard(vocab, shards).groupBy("kind", "shard").applyInArrow(
        _filter, "kind int, shard int, blocks binary")


def passes(sizes: list[tuple[int, int, int]], most: int = 0) -> list[list[tuple[int, int]]]:
    """(kind, shard) of all filters ``(kind, shard, bytes)`` in groups of at most ``most`` bytes."""
    out, held = [], 0
    for kind, shard, size in sorted(sizes):
        if not out or held + size > (most or PASS_BYTES):
            out.append([])
            held = 0
        out[-1].append((kind, shard))
        held += size
    return out


def probed(vocab: DataFrame, alphabet: np.ndarray, filters: Filters) -> DataFrame:
    """``(word, n, near)``: the edits that the filters seem to know."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows in by_size(batch.column("size")):
                for piece in pieces(rows, size):
                    letters = letters_of(batch.column("word").take(pa.array(piece)), size)
                    for found, places, letter in edits(letters, alphabet, filters):
                        for part in pieces(np.arange(len(found)), size):
                            mine = found[part]
                            held = batch.take(pa.array(piece[mine]))
                            near = edited(letters[mine], places[part], letter)
                            yield pa.RecordBatch.from_arrays(
                                [held.column("word"), held.column("n"), pa.array(near, pa.string())],
                                ["word", "n", "near"])

    return vocab.select("word", "n", "size").mapInArrow(probe, "word string, n long, near string")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: all pairs of words one edit apart, each once.

    ``vocab``: written ``(word, n, size)``, words distinct, all letters below U+0100.
    """
    words = max(1, vocab.count())
    vocab = vocab.repartition(max(2, -(-words // PART_WORDS)), "word")
    letters = F.explode(F.array_distinct(F.split("word", "")))
    alphabet = sorted(r[0] for r in vocab.select(letters).distinct().collect() if r[0])  # at most 256
    alphabet = np.frombuffer("".join(alphabet).encode("latin-1"), np.uint8)
    shards = _shards(vocab)
    filters = cut(filter_table(vocab, shards), "filters")
    sizes = [(r["kind"], r["shard"], r["size"])  # a row for each million words
             for r in filters.select("kind", "shard", F.length("blocks").alias("size")).collect()]
    out = None
    for part in passes(sizes):
        wanted = F.struct("kind", "shard").isin([F.struct(F.lit(k), F.lit(s)) for k, s in part])
        rows = filters.where(wanted).collect()  # at most ``PASS_BYTES``, or one filter
        sent = Filters(shards, {(r["kind"], r["shard"]): Filter.load(r["blocks"], r["kind"]) for r in rows})
        found = probed(vocab, alphabet, sent)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vocab.selectExpr("word", "n", "word AS near", "n AS near_n").limit(0)
    known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return out.join(known, "near").select("word", "n", "near", "near_n")


def with_forms(vocab: DataFrame, pairs: DataFrame, factor: int = 2) -> DataFrame:
    """``(word, n, n_near, form, form_n)``: a word's form is its most frequent near word, the
    first in code-point order of several, if it is ``factor`` times as frequent."""
    both = pairs.unionByName(pairs.selectExpr("near AS word", "near_n AS n", "word AS near", "n AS near_n"))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    is_form = F.col("form_n") >= factor * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: the last of word, form, form's form, ...

    Every step doubles the way, and a form is more frequent than its word, so a few rounds end it.
    """
    at = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        at = moved.drop("moved")


def variant_groups(docs: DataFrame, factor: int = 2, **words) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the vocabulary of ``docs (doc_id, text)``.

    ``form``, ``form_n``: NULL for a word without form; its root is the word itself. Repeated
    rows count as often as they are there; an empty table or texts without words give no rows.
    Further columns are not looked at.
    """
    vocab = cut(vocabulary(docs, **words), "vocabulary")
    pairs = cut(near_pairs(vocab), "pairs")  # read in both directions
    forms = cut(with_forms(vocab, pairs, factor), "forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    """All near pairs by their wildcard forms; CRC-32 byte by byte, its table made by its rule."""
    crc = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        crc.append(byte)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE runs AS MATERIALIZED (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{upper}', '{lower}') AS run
            FROM documents WHERE text IS NOT NULL),
        counted AS MATERIALIZED (
            SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)] ELSE [195, ord(ch) - 64] END)) AS bytes
            FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL)),
        hashed AS MATERIALIZED (
            SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, b:
                xor(c >> 8, {crc}[(xor(c, CAST(b AS BIGINT)) & 255) + 1]), 4294967295::BIGINT)) AS h FROM counted),
        vocab AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
                SELECT n, CASE WHEN h % {LOST_EVERY} = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :]
                               ELSE run END AS word FROM hashed)
            WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
        cut AS MATERIALIZED (
            SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM vocab, range(1, length(word) + 1) AS q(i)),
        pairs AS MATERIALIZED (
            SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i
            WHERE a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
        best AS (
            SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
        forms AS MATERIALIZED (
            SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
                   CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
            FROM vocab v LEFT JOIN best USING (word)),
        way(word, root) AS (
            SELECT word, word FROM forms
            UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
        FROM forms f JOIN way w USING (word) JOIN forms l ON l.word = w.root WHERE l.form IS NULL"""


@query("op12_spelling_variants", _sql())
def op12_spelling_variants(spark, sf_dir):
    return variant_groups(table(spark, sf_dir, "documents"))
