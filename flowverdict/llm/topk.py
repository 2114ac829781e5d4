"""Exact top-k inner products by the threshold algorithm (Fagin, Lotem, Naor).

Vectors are dealt into blocks and queries into blocks; a block of each meets in one task. There
every dimension has its own sorted list of the block's vectors. A query reads all lists from
their best end (the largest values where its weight is positive, the smallest where negative),
scores whatever it meets, and stops when the score of a vector made of the values read last
falls below its k-th best: nothing unread can reach that. The best of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import table
from .registry import query

SCALE, EVERY, K = 256, 50, 5
VECTORS, QUERIES = 4096, 512  # of a block
FIRST_DEPTH = 32


def quantised(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v, copies)``: floor(256 x) of every component, equal rows counted.

    Rows without id, NULL or empty vectors and those holding NULL or non-finite components take
    no part.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return (
        embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
        .where(F.coalesce(whole, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    )


class Lists:
    """Sorted lists of a block of vectors, one for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray):
        self.ids, self.vectors, self.copies = ids, vectors, copies
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)

    def best(self, weights: np.ndarray, k: int, own: int) -> tuple[list[int], list[int]]:
        """Places and scores of the ``k`` best (equal rows up to ``k`` times each).

        ``own``: place of the query itself, of which one copy is left out; -1 if elsewhere.
        Ties go to the smaller id.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        seen = np.zeros(n, bool)
        left = np.minimum(self.copies, k + 1)
        if own >= 0:
            left = left.copy()
            left[own] = min(self.copies[own] - 1, k + 1)
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            upto = min(n, depth + step)
            met = np.concatenate([
                self.order[n - upto : n - depth, up].ravel(), self.order[depth:upto, down].ravel()])
            if not len(up) and not len(down):
                met, upto = np.arange(n), n  # all scores are 0
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            fresh = fresh[left[fresh] > 0]
            places = np.concatenate([places, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ weights])
            ranked = np.lexsort((self.ids[places], -scores))
            enough = np.searchsorted(np.cumsum(left[places[ranked]]), k) + 1
            places, scores = places[ranked[:enough]], scores[ranked[:enough]]
            depth, step = upto, 2 * step
            if depth == n:
                break
            bound = self.sorted[n - depth, up] @ weights[up] + self.sorted[depth - 1, down] @ weights[down]
            if left[places].sum() >= k and scores[-1] > bound:
                break
        out = [(p, s) for p, s in zip(places.tolist(), scores.tolist()) for _ in range(int(left[p]))][:k]
        return [p for p, _ in out], [s for _, s in out]


def _cell(k: int):
    def search(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, copies = rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
        marks, asks = rows["mark"].to_numpy(), rows["asks"].to_numpy()
        vectors = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        held = np.flatnonzero(~asks)
        out = [[], [], [], [], []]
        if len(held):
            block = vectors[held]
            if float(np.abs(vectors).max()) ** 2 * vectors.shape[1] < 2**52:
                block, vectors = block.astype(np.float64), vectors.astype(np.float64)  # still exact
            lists = Lists(ids[held], block, copies[held])
            place = {mark: p for p, mark in enumerate(zip(ids[held].tolist(), marks[held].tolist()))}
            for q in np.flatnonzero(asks).tolist():
                own = place.get((int(ids[q]), int(marks[q])), -1)
                places, scores = lists.best(vectors[q], k, own)
                out[0] += [int(ids[q])] * len(places)
                out[1] += [int(marks[q])] * len(places)
                out[2] += [int(copies[q])] * len(places)
                out[3] += lists.ids[places].tolist()
                out[4] += [int(s) for s in scores]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(
            ["query_id", "mark", "asked", "vec_id", "score"], out)})

    return search


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of every row whose id is divisible by ``every`` the
    ``k`` best of all other rows by integer inner product; all, if there are fewer.

    ``vectors``: ``(vec_id, v, copies)``. Only vectors with equally many components are
    compared. Repeated rows are rows: each may be found, each query row is answered. Sums are
    exact while they fit 63 bits.
    """
    marked = vectors.withColumns({"dims": F.size("v"), "mark": F.xxhash64("v")})
    asks = F.col("vec_id") % every == 0
    n, queries = marked.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    blocks, rounds = -(-max(n, 1) // VECTORS), -(-max(queries, 1) // QUERIES)
    h = F.xxhash64("vec_id", "mark")
    held = marked.withColumns({
        "asks": F.lit(False), "i": F.pmod(h, F.lit(blocks)).cast("int"),
        "j": F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))})
    asked = marked.where(asks).withColumns({
        "asks": F.lit(True), "i": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))),
        "j": F.pmod(h, F.lit(rounds)).cast("int")})
    found = held.unionByName(asked).groupBy("dims", "i", "j").applyInArrow(
        _cell(k), "query_id long, mark long, asked long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1), F.col("asked")))
    return ranked.withColumn("again", again).select("query_id", "rank", "vec_id", "score")


SQL = f"""
    WITH v AS (
        SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}"""


@query("op2_threshold_top_k", SQL)
def op2_threshold_top_k(spark, sf_dir):
    return top_k(quantised(table(spark, sf_dir, "embeddings")))
