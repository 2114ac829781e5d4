"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes that are not white space (``[^\\x20\\x09-\\x0D]+``) after A-Z are
lower-cased; the texts are UTF-8. Hashes depend on the bytes alone, so every task and every
run gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
BLOCK = 1 << 20  # bytes hashed at a time
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK + 4096), base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps)
        if len(known) <= 4 * BLOCK:
            _powers[str(base)] = known
    return known[:n]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; NULL counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def is_space(a: np.ndarray) -> np.ndarray:
    return (a == 32) | ((a >= 9) & (a <= 13))


def _hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(a)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers(INVERSE, len(a))[starts]
    return mixed(found ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``starts`` to ``ends`` of bytes, which are in order.

    The bytes are hashed in blocks that end with a span, so a very long text needs no more room
    than a block.
    """
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        first = starts[done]
        upto = max(np.searchsorted(ends, first + BLOCK, "right"), done + 1)
        last = ends[upto - 1]
        out[done:upto] = _hashes(a[first:last], starts[done:upto] - first, ends[done:upto] - first)
        done = upto
    return out


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and the place of each text's first word.

    The second array has one more entry than there are texts.
    """
    blob = b"\n".join(texts) + b"\n"
    low = np.frombuffer(blob.lower(), np.uint8)
    space = is_space(low)
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return hashes(low, starts, ends), np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; of a shorter text, its whole sequence."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, size)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * BASE + hashes[k : k + len(out)])
    return out


def batches_of(column: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column in runs of about ``most_bytes``, each with its first row."""
    run, first, held = [], 0, 0
    for row, text in enumerate(texts_of(column)):
        run.append(text)
        held += len(text)
        if held >= most_bytes:
            yield first, run
            run, first, held = [], row + 1, 0
    if run:
        yield first, run
