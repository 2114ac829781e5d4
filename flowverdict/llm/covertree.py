"""Product codes of vectors: codebooks by Lloyd's rounds over partition-local cover trees.

Vectors are cut into equal parts. Every task builds, for each chunk of its rows and each part, a
cover tree whose nodes know the number and the sum of the points below them. The trees are
written once. A round walks them level by level with the entries that can still be nearest: an
entry farther from a node's centre than the nearest one by more than twice the node's radius is
nearest to no point below it. A node with one entry left gives its whole sum to it; only
ambiguous leaves compare their points. All sums are whole numbers, so the result does not depend
on how the rows are dealt.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, table
from .registry import query

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CHUNK = 8192  # vectors of a tree
LEAF = 24  # points of a node that is not divided further
PAIRS = 1 << 18  # point-entry pairs compared at a time


@dataclass
class Tree:
    """Distinct points in tree order, and nodes level by level.

    ``row_of``: for every vector of the chunk its point. ``weight``: copies of a point.
    A node covers ``points[start:end]``, the first of which is its centre; its children are
    ``child`` to ``child + children``.
    """

    points: np.ndarray
    weight: np.ndarray
    row_of: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree of integer vectors. Children of a node are centres more than half its radius
    apart, and each covers what is within that half; equal vectors are one point."""
    points, row_of, weight = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    places = points.astype(np.float64)
    order = np.arange(len(points))
    start, end, radius, child, children = [0], [len(points)], [], [], []
    todo = 0
    while todo < len(start):
        lo, hi = start[todo], end[todo]
        members = order[lo:hi].copy()
        far = np.sqrt(((places[members] - places[members[0]]) ** 2).sum(axis=1))
        radius.append(float(far.max()))
        child.append(len(start))
        if hi - lo > leaf:
            at = lo
            near = far <= radius[-1] / 2
            while len(members):
                own = members[near]
                order[at : at + len(own)] = own
                start.append(at)
                at += len(own)
                end.append(at)
                members = members[~near]
                if len(members):
                    near = np.sqrt(((places[members] - places[members[0]]) ** 2).sum(axis=1)) <= radius[-1] / 2
        children.append(len(start) - child[-1])
        todo += 1
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return Tree(points[order].astype(np.int64), weight[order].astype(np.int64), place[row_of.ravel()],
                *(np.array(x) for x in (start, end, radius, child, children)))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every point to every entry."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


FAR = np.iinfo(np.int64).max


def walk(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of the tree's points with their nearest entry (ties: the first): starts, ends, entries."""
    nodes = np.zeros(1, np.int64)
    left = np.ones((1, len(entries)), bool)
    step = max(1, PAIRS // len(entries))
    while len(nodes):
        next_nodes, next_left = [np.zeros(0, np.int64)], [np.zeros((0, len(entries)), bool)]
        for k in range(0, len(nodes), step):
            at, may = nodes[k : k + step], left[k : k + step]
            found = np.where(may, squares(tree.points[tree.start[at]], entries), FAR)
            best = found.argmin(axis=1)
            far = np.sqrt(found.astype(np.float64))
            bound = far[np.arange(len(at)), best] + 2 * tree.radius[at]
            may &= far <= (bound * (1 + 1e-9) + 1e-6)[:, None]
            sure = (may.sum(axis=1) == 1) | (tree.radius[at] == 0)
            yield tree.start[at[sure]], tree.end[at[sure]], best[sure]
            at, may = at[~sure], may[~sure]
            down = tree.children[at] > 0
            # Ambiguous leaves compare their points.
            for node, some in zip(at[~down].tolist(), may[~down]):
                lo, hi = tree.start[node], tree.end[node]
                some = np.flatnonzero(some)
                near = some[squares(tree.points[lo:hi], entries[some]).argmin(axis=1)]
                yield np.arange(lo, hi), np.arange(lo, hi) + 1, near
            at, may = at[down], may[down]
            many = tree.children[at]
            first = np.repeat(tree.child[at] - np.cumsum(many) + many, many)
            next_nodes.append(first + np.arange(many.sum()))
            next_left.append(np.repeat(may, many, axis=0))
        nodes, left = np.concatenate(next_nodes), np.concatenate(next_left)


def totals(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the vectors nearest to each entry."""
    below = np.concatenate([[0], np.cumsum(tree.weight)])
    total = np.zeros((len(tree.points) + 1, tree.points.shape[1]), np.int64)
    np.cumsum(tree.points * tree.weight[:, None], axis=0, out=total[1:])
    n, s = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for lo, hi, near in walk(tree, entries):
        np.add.at(n, near, below[hi] - below[lo])
        np.add.at(s, near, total[hi] - total[lo])
    return n, s


def nearest(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector of the chunk its nearest entry and the squared distance to it."""
    out = np.zeros(len(tree.points), np.int64)
    for lo, hi, near in walk(tree, entries):
        many = hi - lo
        out[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())] = np.repeat(near, many)
    error = ((tree.points - entries[out]) ** 2).sum(axis=1)
    return out[tree.row_of], error[tree.row_of]


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v)``: floor(256 x) of every component.

    Vectors that are NULL, or hold NULL or non-finite components, are left out. Sums and squares
    are exact while they fit 63 bits.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return embeddings.where(F.coalesce(whole, F.lit(False))).select("vec_id", "label", v.alias("v"))


def grown_trees(vectors: DataFrame, parts: int) -> DataFrame:
    """Chunks ``(ids, labels, trees)`` of the rows of each task; no row leaves its task."""
    kinds = dict(vectors.dtypes)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                chunk = batch.slice(at, CHUNK)
                v = chunk.column("v").flatten().to_numpy().reshape(chunk.num_rows, parts, -1)
                trees = [build(v[:, k]) for k in range(parts)]
                ends = pa.array([0, chunk.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(ends, chunk.column("vec_id")),
                     pa.ListArray.from_arrays(ends, chunk.column("label")),
                     pa.array([pickle.dumps([small(t) for t in trees])])], ["ids", "labels", "trees"])

    return vectors.mapInArrow(
        grow, f"ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, trees binary")


def small(tree: Tree) -> Tree:
    """The tree with its whole numbers in the narrowest type that holds them."""
    def narrow(x: np.ndarray) -> np.ndarray:
        if x.dtype.kind != "i" or not x.size:
            return x
        return x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))

    return Tree(*(narrow(getattr(tree, f)) for f in Tree.__dataclass_fields__))


def wide(tree: Tree) -> Tree:
    return Tree(*(x.astype(np.int64) if x.dtype.kind in "iu" else x
                  for x in (getattr(tree, f) for f in Tree.__dataclass_fields__)))


def trees_of(blob: bytes) -> list[Tree]:
    return [wide(t) for t in pickle.loads(blob)]


def one_round(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: the rounded-down mean of what each entry is nearest to; unused ones stay.

    The driver gets one row for each entry.
    """
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                for k, tree in enumerate(trees_of(blob.as_py())):
                    more, total = totals(tree, books[k])
                    n[k] += more
                    s[k] += total
        used = n.ravel() > 0
        every = np.arange(0, used.sum() * (width + 1) + 1, width + 1, dtype=np.int32)
        flat = np.concatenate([n[..., None], s], axis=2).reshape(-1, width + 1)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.flatnonzero(used)), pa.ListArray.from_arrays(pa.array(every), pa.array(flat.ravel()))],
            ["entry", "sums"])

    rows = chunks.select("trees").mapInArrow(add, "entry long, sums array<long>")
    summed = rows.groupBy("entry").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width + 1)])
    out = books.copy().reshape(-1, width)
    for entry, n, *s in summed.collect():
        out[entry] = [x // n for x in s]
    return out.reshape(books.shape)


def codes(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)`` of all vectors of the chunks."""
    kinds = {k: t[len("array<"):-1] for k, t in chunks.dtypes if k != "trees"}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(row, 1).flatten() for c in ("ids", "labels"))
                near, error = zip(*(nearest(t, books[k])
                                    for k, t in enumerate(trees_of(batch.column("trees")[row].as_py()))))
                packed = np.stack(near, axis=1).astype(np.uint8)
                code = [r.tobytes().hex() for r in packed]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(code, pa.string()), pa.array(np.sum(error, axis=0))],
                    ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(
        assign, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def sha256_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error)`` of ``vectors (vec_id, label, v)``, and the codebooks.

    A codebook starts as that part of the vectors with the ``entries`` (at most 256) smallest
    ids; equal ids are taken in order of the vector. Of equally near entries the first is taken.
    Repeated rows are rows: each counts and gets its code. Vectors of another length than the
    first that ``parts`` divides cannot be cut, and those without an id are not coded: their code
    and error are NULL. Labels may be NULL; other columns are not looked at. An empty table gives
    no rows and empty codebooks; with fewer vectors the codebooks have fewer entries.
    """
    divides = (F.size("v") > 0) & (F.size("v") % parts == 0)
    first = vectors.where(divides & F.col("vec_id").isNotNull()).orderBy("vec_id", "v").select("v").first()
    width = len(first["v"]) if first else -1
    fits = (F.size("v") == width) & F.col("vec_id").isNotNull()
    start = vectors.where(fits).orderBy("vec_id", "v").select("v").limit(entries).collect()
    none = vectors.where(~fits).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not start:
        return none, np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    books = np.ascontiguousarray(books)
    chunks = cut(grown_trees(vectors.where(fits), parts), "trees")
    for _ in range(rounds):
        books = one_round(chunks, books)
    return codes(chunks, books).unionByName(none), books


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``: the error summed over equal labels, NULLs together."""
    of = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    return rows.join(of, rows["label"].eqNullSafe(of["_of"])).drop("_of")


def _sql() -> str:
    """Lloyd's rounds by comparing every part with every entry."""
    views = [f"""v AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
               [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""parts AS MATERIALIZED (
        SELECT r, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS x FROM v, range({PARTS}) AS q(p))""",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM parts WHERE r <= {ENTRIES})"]
    for n in range(ROUNDS + 1):
        views.append(f"""a{n} AS MATERIALIZED (
            SELECT r, p, any_value(x) AS x, arg_min(k, {ENTRIES} * d + k) AS k, CAST(min(d) AS BIGINT) AS d FROM (
                SELECT r, t.p, x, k, list_dot_product(x::DOUBLE[], x::DOUBLE[]) + list_dot_product(c::DOUBLE[], c::DOUBLE[])
                       - 2 * list_dot_product(x::DOUBLE[], c::DOUBLE[]) AS d FROM parts t JOIN b{n} b ON b.p = t.p)
            GROUP BY r, p)""")
        if n < ROUNDS:
            views.append(f"""b{n + 1} AS MATERIALIZED (
                SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN (
                    SELECT p, k, list(mean ORDER BY i) AS c FROM (
                        SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS mean
                        FROM a{n}, range(1, len(x) + 1) AS q(i) GROUP BY p, k, i) GROUP BY p, k) m
                ON m.p = b.p AND m.k = b.k)""")
    views.append(f"""codes AS (
        SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
        FROM a{ROUNDS} GROUP BY r)""")
    views.append(f"""books AS (
        SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, k, i)) AS codebooks_sha256
        FROM b{ROUNDS}, range(1, len(c) + 1) AS q(i))""")
    return "WITH " + ",\n".join(views) + """
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM v JOIN codes USING (r) CROSS JOIN books"""


@query("op11_cover_tree_codes", _sql())
def op11_cover_tree_codes(spark, sf_dir):
    rows, books = coded(quantised(table(spark, sf_dir, "embeddings")))
    rows = with_label_error(cut(rows, "codes"))
    return rows.select("vec_id", "code", "error", "label_error",
                       F.lit(sha256_of(books)).alias("codebooks_sha256"))
