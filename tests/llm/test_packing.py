import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from flowverdict.llm import packing as p


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(p.default_tokenizer())


def whole(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    texts = ["", "a  b", "It's DON'T we'Ll 12.5%% <|endoftext|>x <|startoftext|", "é É é ÄÖß İstanbul ΣΑΣ",
             "tab\tnew\r\nline\x0bv\x1cf\x00  nb sp", "日本語 text 🙂🙂 ½ ²", "x'S 'T ''' ...!!??", "ﬁ ẞ K Å"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aB'é .,9\n<|>́ñ") for _ in range(60)) for _ in range(300)]
    for text, packed in zip(texts, p.WordIds(p.default_tokenizer()).ids(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == whole(text), text


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(40):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 120))]
        bins = []
        for x in sorted(lengths, reverse=True):
            fits = [k for k in range(len(bins)) if bins[k] >= x]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= x
            else:
                bins.append(capacity - x)
        held, seen = {}, Counter()
        for length, rank, items, first, each, used in p.plan(Counter(lengths), capacity):
            for k in range(items):
                seen[length, rank + k] += 1
                held.setdefault(first + k // each, []).append((used + k % each * length, length))
        assert len(held) == len(bins)
        assert sorted(seen) == sorted((x, k) for x, n in Counter(lengths).items() for k in range(n))
        for parts in held.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            assert end <= capacity


def check_slots(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= capacity
    return held


def test_pack(spark, documents, hard):
    rows = hard + [(1000 + k, "same words again") for k in range(300)]
    out = p.pack(documents(rows, ["sequence_id", "rank", "length"])).collect()
    check_slots(out, p.CAPACITY)
    want = Counter()
    for i, text in rows:
        ids = whole(text or "") + [0]
        for n, at in enumerate(range(0, len(ids), p.CAPACITY)):
            part = np.array(ids[at : at + p.CAPACITY], "<u4")
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want


def test_pieces_keep_the_ids(spark, documents):
    out = p.pieces(documents([(1, "some words here and there")]), p.default_tokenizer(), 4, ids=True)
    parts = sorted((r["piece"], r["ids"]) for r in out.collect())
    assert [x for _, part in parts for x in part] == whole("some words here and there") + [0]


def test_empty_table(spark, documents):
    assert p.pack(documents([])).count() == 0


def test_ids_with_small_tables(monkeypatch):
    """Long texts in parts, full tables, pieces taken over from the older table."""
    monkeypatch.setattr(p, "RUN_BYTES", 300)
    monkeypatch.setattr(p, "KEPT_PIECES", 40)
    monkeypatch.setattr(p, "RUN_PIECES", 25)
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcdeéßÀ'1,.") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts = [rng.choice([" ", "\n", "\x0b "]).join(rng.choices(stock, k=rng.choice([0, 3, 40, 400]))) for _ in range(30)]
    texts.append("x" * 2000 + " <|startoftext|> " + "ab " * 500)
    for text, packed in zip(texts, p.WordIds(p.default_tokenizer()).ids(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == whole(text), text


def test_id_table_finds_what_it_was_given():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    many = rng.integers(0, 4, len(keys))
    ids = rng.integers(0, 50_000, many.sum()).astype("<u4")
    table = p.IdTable(16)
    for part in np.array_split(np.arange(len(keys)), 7):
        low, high = many[: part[0]].sum(), many[: part[-1] + 1].sum()
        table.add(keys[part], many[part], ids[low:high])
    order = rng.permutation(len(keys))
    ends = np.cumsum(many)
    want = [ids[ends[k] - many[k] : ends[k]] for k in order]
    assert (table.gather(table.find(keys[order])) == np.concatenate(want)).all()
    assert (table.find(keys ^ np.uint64(1 << 40)) < 0).all()


def test_tokenizers_that_join_words_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="alone"):
        p.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
