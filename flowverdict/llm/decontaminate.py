"""Benchmark passages in documents: SimHash of item-sized windows, then exact similarity.

Items and documents are read as words. A window of a document is as large as an item (sizes go
down to the next one of a ladder, so that all items need few passes over a text). Its 64-bit
SimHash counts the bits of the hashes of its words, by running sums for all windows at once.

An item is represented by fingerprints of its first and last full-sized windows, and of pieces
of at most half its size. A similarity of 0.8 leaves a long item at most one changed word in
45, so of pieces no longer than 22 words at least one is unchanged in any similar passage: its
fingerprint is at distance 0.

Fingerprints within ``RADIUS`` bits agree in at least one of ``RADIUS + 1`` blocks of 16 bits
(pigeonhole), so a window whose blocks are all unknown is out and nothing within the radius is
missed. Candidates are verified on whole item-sized windows by the weighted Jaccard similarity
of 5-word shingles, each as often as it occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as w
from .common import giving_back, table, unused
from .registry import query

PERCENT = 80
RADIUS = 3
BLOCKS = RADIUS + 1
RUNG = 1.25
PIECE = 22
# Benchmark words whose index is sent to the tasks at once; a larger benchmark takes several
# passes over the documents.
PASS_WORDS = 2_000_000
WINDOWS = 1 << 12  # at a time: their running sums stay in the cache
U64 = np.uint64


def ladder(n: int) -> int:
    """The largest window size that is not above ``n``."""
    size, best = 1.0, 1
    while size < n + 1:
        best = int(size)
        size = max(size * RUNG, best + 1.0)
    return best


def fingerprints(bits: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words; ``bits``: running sums of +1/-1 per bit."""
    over = (bits[size:] - bits[:-size]) > 0
    return np.packbits(over.ravel(), bitorder="little").view("<u8")


def bit_sums(hashes: np.ndarray, largest: int) -> np.ndarray:
    """The sums may overflow; the difference over a window of up to ``largest`` is still right."""
    kind = np.int16 if largest < 1 << 15 else np.int32
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(ones.view(np.int8) * np.int8(2) - np.int8(1), axis=0, dtype=kind, out=sums[1:])
    return sums


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared occurrences over all occurrences."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


class Index:
    """Benchmark items by the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = []  # (item id, words, shingles)
        entries = defaultdict(list)  # window size -> (fingerprint, item, offset)
        for item_id, text in items:
            hashes, _ = w.words([text])
            if not len(hashes):
                continue
            n, k = len(hashes), len(self.items)
            self.items.append((item_id, n, Counter(w.shingles(hashes).tolist())))
            sums = bit_sums(hashes, n)
            whole, part = ladder(n), ladder(max(1, min(PIECE, n // 2)))
            places = {(whole, 0), (whole, n - whole)}
            places |= {(part, at) for at in range(0, n - part + 1, part)} | {(part, n - part)}
            for size, at in places:
                entries[size].append((fingerprints(sums[at : at + size + 1], size)[0], k, at))
        self.sizes = {}
        for size, found in entries.items():
            prints = np.array([f for f, _, _ in found], U64)
            blocks = prints.view("<u2").reshape(-1, BLOCKS).astype(np.int64)
            order = np.argsort(blocks, axis=0, kind="stable")
            # Entries by the value of a block: those of value v are order[first[v] : first[v + 1]].
            first = [np.searchsorted(blocks[order[:, b], b], np.arange((1 << 16) + 1))
                     for b in range(BLOCKS)]
            known = [np.diff(f) > 0 for f in first]
            self.sizes[size] = (
                prints, np.array([[k, at] for _, k, at in found]), known, order, first)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) of windows within the radius of an item's fingerprint.

        ``first word`` is where the whole item would begin; several windows may name one place.
        """
        bounds, largest = at[1:], max(self.sizes, default=0)
        step = max(WINDOWS, 4 * largest)
        for low in range(0, len(hashes), step):
            # Blocks overlap by the largest window, so each window lies in one of them.
            high = min(len(hashes), low + step + largest)
            sums = bit_sums(hashes[low:high], largest)
            for size, (prints, places, known, order, first) in self.sizes.items():
                if high - low < size:
                    continue
                found = fingerprints(sums, size)[:step]
                blocks = found.view("<u2").reshape(-1, BLOCKS)
                for b in range(BLOCKS):
                    at_p = np.flatnonzero(known[b].take(blocks[:, b]))
                    value = blocks[at_p, b].astype(np.int64)
                    many = first[b][value + 1] - first[b][value]
                    p = np.repeat(at_p, many)
                    skip = np.repeat(first[b][value] - np.cumsum(many) + many, many)
                    e = order[skip + np.arange(len(p)), b]
                    near = np.bitwise_count(found[p] ^ prints[e]) <= RADIUS
                    p, e = p[near], e[near]
                    text = np.searchsorted(bounds, low + p, "right")
                    inside = low + p + size <= bounds[text]  # not on into the next text
                    for t, place, (k, offset) in zip(
                            text[inside].tolist(), p[inside].tolist(), places[e[inside]].tolist()):
                        yield t, k, low + place - offset

    def matches(self, hashes: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """{(text, item): (similarity, first word)} of the verified passages, the best of each."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        seen = set()
        for text, k, start in self.candidates(hashes, at):
            if (text, k, start) in seen:
                continue
            seen.add((text, k, start))
            _, n, wanted = self.items[k]
            first, last = int(at[text]), int(at[text + 1])
            # A word more or less before the window moves the item by as much.
            shift = n // (2 * PIECE)
            for begin in range(start - shift, start + shift + 1):
                begin = min(max(begin, first), max(first, last - n))
                window = hashes[begin : min(begin + n, last)]
                like = similarity(wanted, Counter(w.shingles(window).tolist()))
                if like * 100 >= PERCENT - 1e-9 and (like, first - begin) > best.get((text, k), (0.0, 0)):
                    best[text, k] = (like, first - begin)
        return {key: (like, -place) for key, (like, place) in best.items()}


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in parts of at most about ``PASS_WORDS`` words; rows of NULL or empty text are
    no items, repeated rows count once."""
    part, held = [], 0
    source = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    for item_id, text in source.where("text IS NOT NULL").distinct().toLocalIterator():
        part.append((item_id, bytes(text)))
        held += len(text) // 2 + 1
        if held >= PASS_WORDS:
            yield part
            part, held = [], 0
    if part:
        yield part


def _scan(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    def read(batches):
        index = Index(items)
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in w.batches_of(batch.column("text")):
                hashes, at = w.words(texts)
                rows = [(ids[first + text].as_py(), index.items[k][0], like, place)
                        for (text, k), (like, place) in index.matches(hashes, at).items()]
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.record_batch(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())],
                    ["doc_id", "item_id", "similarity", "word"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(giving_back(read), "doc_id long, item_id long, similarity double, word long")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, word)``: every item that a document holds a passage of.

    ``word`` is where the best passage begins. A similarity of 0.8 or more counts; words are
    compared with A-Z lower-cased. NULL and empty texts match nothing, an item of fewer than
    five words is one shingle. Rows whose id is NULL give rows with a NULL id, repeated rows
    each give theirs. Other columns are not read; empty tables give no rows.
    """
    out = None
    for items in _passes(benchmark):
        part = _scan(docs, items)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, item_id long, similarity double, word long")
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item; all columns are kept."""
    (name,) = unused(docs, "leaked")
    place = docs.columns.index("text")
    out = docs

    for items in _passes(benchmark):
        def flag(batches, items=items):
            index = Index(items)
            for batch in batches:
                found = np.zeros(batch.num_rows, bool)
                for first, texts in w.batches_of(batch.column(place)):
                    hashes, at = w.words(texts)
                    for text, _ in index.matches(hashes, at):
                        found[first + text] = True
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found)], [*batch.schema.names, name])

        kind = T.StructType([*docs.schema.fields, T.StructField(name, T.BooleanType())])
        out = out.mapInArrow(giving_back(flag), kind).where(~F.col(name)).drop(name)
    return out


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
