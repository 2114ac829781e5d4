"""Best-fit packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing only looks at lengths, so it is planned over (length, count) on the driver:
at most ``capacity`` lengths whatever the corpus. The plan is a list of runs, each of which
gives the items of one length with ranks in an interval their sequences and offsets; documents
take their slots by joining on (length, rank within the length).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as w
from .common import cut, giving_back, table, unused, with_ranks
from .registry import query

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = np.zeros(1, "<u4")
# Pieces a table of ids takes before the next one is begun; pieces of texts coded in one go.
KEPT_PIECES, RUN_PIECES = 1_000_000, 100_000
RUN_BYTES = 1 << 20
LEARNT = 500  # new pieces that the tokenizer gets in one text
PROBE = "The quick brown Fox, it's 12.5%% over\tÉté\nnaïve  l'été ... x_y \u0130 9a"


class IdTable:
    """Token ids of pieces by the pieces' 64-bit hashes: open addressing in flat arrays."""

    def __init__(self, slots: int = 1 << 16):
        self.keys = np.zeros(slots, np.uint64)
        self.start, self.many = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids = np.zeros(slots, "<u4")
        self.pieces = self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``, -1 where there is none."""
        last = len(self.keys) - 1
        out = np.full(len(keys), -1, np.int64)
        at, left = (keys & np.uint64(last)).astype(np.int64), np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = at[hit]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & last
        return out

    def add(self, keys: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new ``keys`` with ``many`` ids each, one after another in ``ids``."""
        while 2 * (self.pieces + len(keys)) > len(self.keys):
            self._grow()
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self._put(keys, self.used + np.cumsum(many) - many, many)
        self.used += len(ids)
        self.pieces += len(keys)

    def _put(self, keys: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
        last = len(self.keys) - 1
        at, left = (keys & np.uint64(last)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            own = left[free]
            self.keys[at[free]], self.start[at[free]], self.many[at[free]] = keys[own], start[own], many[own]
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, at = left[rest], (at[rest] + 1) & last

    def _grow(self) -> None:
        held = np.flatnonzero(self.keys)
        old = self.keys[held], self.start[held], self.many[held]
        self.keys = np.zeros(2 * len(self.keys), np.uint64)
        self.start, self.many = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32)
        self._put(*old)

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of all ``places`` in order."""
        many = self.many[places].astype(np.int64)
        skip = np.repeat(self.start[places] - np.cumsum(many) + many, many)
        return self.ids[skip + np.arange(len(skip))]


def pieces_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of a text that the tokenizer codes alone: bytes, starts and ends.

    White space parts pieces. A word of letters a-z and U+00C0-U+00FF, digits and other ASCII
    signs without an apostrophe is parted further, into runs of letters, single digits and runs
    of signs, and its A-Z are lower-cased; any other word is one piece, as it is.
    """
    raw, low = np.frombuffer(blob, np.uint8), np.frombuffer(blob.lower(), np.uint8)
    space = w.is_space(raw)
    kind = np.full(len(raw), 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 sign, 4 beyond these
    kind[(low >= 97) & (low <= 122)] = 1
    kind[(low >= 48) & (low <= 57)] = 2
    kind[(low >= 127) | (low < 32) | (low == 39)] = 4
    kind[space] = 0
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # not the signs of times and divided
    kind[lead] = kind[lead + 1] = 1
    begins = np.diff(space.view(np.int8), prepend=np.int8(1)) == -1
    word = np.cumsum(begins, dtype=np.int32) - 1
    plain = np.ones(int(word[-1]) + 2 if len(word) else 1, bool)
    plain[word[kind == 4]] = False
    marks = np.flatnonzero((low[:-1] == 60) & (low[1:] == 124))  # <| may begin a special token
    plain[word[marks]] = False
    mine = plain[word] & ~space
    change = np.diff(kind, prepend=np.int8(0)) != 0
    starts = begins | (mine & (change | (kind == 2)))
    after = np.append(starts[1:] | space[1:], True)
    return np.where(mine, low, raw), np.flatnonzero(starts), np.flatnonzero(after & ~space) + 1


class WordIds:
    """Token ids of texts, looked up piece by piece.

    The tokenizer drops white space and codes the pieces of ``pieces_of`` alone, so the ids of a
    text are those of its pieces one after another; a tokenizer that does not is refused. Pieces
    are told apart by 64-bit hashes of their bytes. A full table becomes the older one, from
    which pieces that come again are taken over; the one before it goes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.between = next(
            ((i, t.content) for i, t in sorted(added.items())
             if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), (None, None))
        self.now, self.older = IdTable(), IdTable(2)
        if next(self.ids([PROBE])) != np.array(
                self.tokenizer.encode(PROBE, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError("the tokenizer does not code words alone")

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for packed in self.coded([t.encode() for t in texts]):
            yield packed.tobytes()

    def coded(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        short = [t for t in texts if len(t) <= RUN_BYTES]
        found = self._run(short) if sum(map(len, short)) <= 4 * RUN_BYTES else (self._run([t])[0] for t in short)
        found = iter(found)
        for text in texts:
            if len(text) <= RUN_BYTES:
                yield next(found)
            else:
                yield np.concatenate([self._run([part])[0] for part in _blocks(text)])

    def _run(self, texts: list[bytes]) -> list[np.ndarray]:
        blob = b"\n".join(texts) + b"\n"
        buffer, starts, ends = pieces_of(blob)
        keys = w.hashes(buffer, starts, ends)
        keys[keys == 0] = 1
        parts, many = [END[:0]], np.zeros(len(keys) + 1, np.int64)
        for low in range(0, len(keys), RUN_PIECES):
            some = slice(low, low + RUN_PIECES)
            places = self._places(keys[some], buffer, starts[some], ends[some])
            parts.append(self.now.gather(places))
            many[low + 1 : low + 1 + len(places)] = self.now.many[places]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        flat, edges = np.concatenate(parts), np.cumsum(many)[first]
        return [flat[low:high] for low, high in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def _places(self, keys: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.now.pieces > KEPT_PIECES:
            self.now, self.older = IdTable(), self.now
        places = self.now.find(keys)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            before = self.older.find(new)
            again = before >= 0
            self.now.add(new[again], self.older.many[before[again]], self.older.gather(before[again]))
            rest = first[~again]
            pieces = [buffer[s:e].tobytes().decode() for s, e in zip(starts[rest].tolist(), ends[rest].tolist())]
            ids, many = self._learn(pieces)
            self.now.add(new[~again], many, ids)
            places = self.now.find(keys)
        return places

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        out: list[np.ndarray] = [END[:0]] * len(pieces)
        joined = [k for k, x in enumerate(pieces) if self.between and "<|" not in x and self.between[:2] not in x]
        runs = [joined[k : k + LEARNT] for k in range(0, len(joined), LEARNT)]
        texts = [self.between.join([pieces[k] for k in run]) for run in runs]
        for run, code in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(code.ids, "<u4")
            for k, part in zip(run, np.split(ids, np.flatnonzero(ids == self.mark))):
                out[k] = part[1:] if k != run[0] else part
        alone = sorted(set(range(len(pieces))) - set(joined))
        for k, code in zip(alone, self.tokenizer.encode_batch_fast(
                [pieces[k] for k in alone], add_special_tokens=False)):
            out[k] = np.array(code.ids, "<u4")
        return np.concatenate([END[:0], *out]), np.fromiter(map(len, out), np.int64, len(out))


def _blocks(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``RUN_BYTES`` that end at white space."""
    at = 0
    while at < len(text):
        upto = at + RUN_BYTES
        while upto < len(text) and text[upto] not in b" \t\n\r\x0b\x0c":
            upto += 1
        yield text[at:upto]
        at = upto


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Token ids of every document, end id 0 added, cut where they exceed ``capacity``.

    With ``ids`` the ids themselves follow as ``array<int>``. A NULL or empty text is the end
    id alone; repeated rows each give their pieces.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                      ("length", pa.int64()), ("ids_crc32", pa.int64())]
                     + [("ids", pa.list_(pa.int32()))] * ids)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordIds(tokenizer)
        for batch in batches:
            doc_ids, rows = batch.column("doc_id"), []
            for first, texts in w.batches_of(batch.column("text"), RUN_BYTES):
                for row, packed in enumerate(of.coded(texts), first):
                    packed = np.concatenate([packed, END])
                    doc_id = doc_ids[row].as_py()
                    for number, at in enumerate(range(0, len(packed), capacity)):
                        part = packed[at : at + capacity]
                        rows.append((doc_id, number, at, len(part), zlib.crc32(part))
                                    + ((part.tolist(),) if ids else ()))
            columns = list(zip(*rows)) or [()] * len(kind)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind)], kind)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(giving_back(cut_up), PIECES + ", ids array<int>" * ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Best-fit decreasing over counts.

    Items of a length go, longest first, each to the fullest sequence that still holds it. A
    sequence that takes one is then the fullest, so it takes as many as fit: sequences that
    look alike are filled together, and the work depends on the number of different lengths,
    not of items. Gives runs (length, first rank, items, first sequence, items per sequence,
    offset of the first item).
    """
    room: dict[int, list[tuple[int, int, int]]] = {}  # left -> (first sequence, how many, used)
    runs, sequences = [], 0

    def fill(length: int, rank: int, items: int, first: int, used: int, left: int) -> None:
        each = left // length
        runs.append((length, rank, items, first, each, used))
        whole, rest = divmod(items, each)
        for start, many, taken in ((first, whole, each), (first + whole, int(rest > 0), rest)):
            if many and left > taken * length:
                room.setdefault(left - taken * length, []).append((start, many, used + taken * length))

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        for left in sorted(x for x in room if x >= length):
            each = left // length
            while count and room[left]:
                first, many, used = room[left].pop()
                taken = min(many, -(-count // each))
                if taken < many:
                    room[left].append((first + taken, many - taken, used))
                items = min(count, taken * each)
                fill(length, rank, items, first, used, left)
                rank, count = rank + items, count - items
            if not count:
                break
        if count:
            fill(length, rank, count, sequences, 0, capacity)
            sequences += -(-count // (capacity // length))
        room = {k: v for k, v in room.items() if v}
    return runs


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` (with a column ``length`` from 1 to ``capacity``) with their slots.

    Adds ``sequence_id`` and ``offset``. Pieces are ranked within their length in buckets, so a
    length that very many pieces have is still numbered by many tasks.
    """
    spark = cut_pieces.sparkSession
    rank, low, items, first, each, used = unused(
        cut_pieces, "rank", "low", "items", "first_sequence", "each", "used")
    counts = cut_pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs = plan({r["length"]: r["count"] for r in counts}, capacity)
    length = unused(cut_pieces, "run_length")[0]
    slots = spark.createDataFrame(
        runs, f"{length} long, {low} long, {items} long, {first} long, {each} long, {used} long")
    ranked = with_ranks(cut_pieces, ["length"], rank, sum(r["count"] for r in counts))
    # The plan has a few runs for each of at most ``capacity`` lengths, whatever the corpus.
    found = ranked.join(
        F.broadcast(slots),
        (ranked["length"] == slots[length]) & (ranked[rank] >= slots[low])
        & (ranked[rank] < slots[low] + slots[items]),
    )
    place = F.col(rank) - F.col(low)
    return found.select(
        *cut_pieces.columns,
        (F.col(first) + F.floor(place / F.col(each))).cast("long").alias("sequence_id"),
        (F.col(used) + (place % F.col(each)) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; a row per piece."""
    cut_pieces = cut(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    return packed(cut_pieces, capacity)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
