"""Join of documents whose sets of word shingles are alike, over prefix trees.

Exact: two documents link when the Jaccard similarity of their shingle sets is at least the
threshold. Documents with equal sets are one class, and all steps work on classes.

1. ``shingle_sets`` gives every document the digest of its set.
2. ``partly_shared`` keeps the classes that can have a partner at all. Sets with similarity t
   share the first k common shingles within their first ``n - ceil(t n) + k`` shingles of any
   global order, so a class too few of whose first shingles occur in another class is out.
3. ``candidate_groups`` connects the rest through shared shingles of their prefixes (k = 1).
   The order is by the number of sets that have a shingle: those of one set come first.
4. ``trie_links`` joins the sets of one group: they are stored in a prefix tree, most frequent
   shingle first, and every set walks the tree once; sets that start alike share the overlap
   counted so far, and a subtree is left as soon as the remaining lengths can't reach the
   needed overlap. Subtrees already connected with the walking set are skipped. Large groups
   are cut into chunks that meet in cells of two, first every chunk with itself and with the
   first one; further cells are made only where that left a group in several components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words as w
from .common import cut, giving_back, table, unused
from .components import components, small, stars
from .registry import query

PERCENT = 80  # least similarity
EXTRA = 25  # of 100 shingles, those by which the first prefixes are longer
TOKENS_A_BUCKET = 4_000_000
FLUSH = 2_000_000
MARK = 65_535
CHUNK = 100
SAMPLED, FREQUENT = 4000, 8  # sets looked at for frequent shingles, and in how many they are
U64 = np.uint64
LOW48 = U64((1 << 48) - 1)


def least_common(n):
    """Shingles that a set of ``n`` shares with any set similar to it."""
    return -(-PERCENT * n // 100)


def extra(n):
    return -(-EXTRA * n // 100)


def needed(n, m):
    """Overlap at which sets of ``n`` and ``m`` shingles reach the threshold."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for first, texts in w.batches_of(column):
        hashes, at = w.words(texts)
        for k in range(len(texts)):
            yield first + k, np.unique(w.shingles(hashes[at[k] : at[k + 1]]))


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _key(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, digest)`` of every row; ``digest`` is NULL for a set without shingles."""

    def read(batches):
        for batch in batches:
            n, digests = [], []
            for _, tokens in _sets(batch.column("text")):
                n.append(len(tokens))
                digests.append(_digest(tokens) if len(tokens) else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary())],
                ["doc_id", "n", "digest"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(giving_back(read), "doc_id long, n long, digest binary")


BLOB = "bucket int, high binary, low binary, owner binary, keys binary, own binary, own_n binary"


def _deal(buckets: int):
    """Map side of ``partly_shared``: the first shingles of many sets, as arrays per bucket.

    A shingle that two sets of the task share is settled there; one mark of it goes on.
    """

    def flush(parts, keys):
        tokens = np.concatenate(parts) & LOW48
        owner = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
        runs = np.diff(np.append(first, len(tokens)))
        shared = np.repeat(runs > 1, runs)
        kept = ~shared
        kept[first] = True
        sent = np.where(shared, np.uint16(MARK), owner)[kept]
        sent_tokens = tokens[kept]
        place = lambda t: ((t >> U64(24)) * U64(buckets)) >> U64(24)
        edges = np.searchsorted(place(sent_tokens), np.arange(buckets + 1, dtype=U64))
        own_tokens, own = tokens[shared], owner[shared]
        own_edges = np.searchsorted(place(own_tokens), np.arange(buckets + 1, dtype=U64))
        rows = []
        for b in range(buckets):
            t, o = sent_tokens[edges[b] : edges[b + 1]], sent[edges[b] : edges[b + 1]]
            mine, many = np.unique(own[own_edges[b] : own_edges[b + 1]], return_counts=True)
            if len(t):
                rows.append((b, (t >> U64(32)).astype("<u2").tobytes(), t.astype("<u4").tobytes(),
                             o.astype("<u2").tobytes(), keys.tobytes(),
                             mine.astype("<u2").tobytes(), many.astype("<u4").tobytes()))
        return pa.record_batch(
            [pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))],
            BLOB.replace(" binary", "").replace(" int", "").split(", "))

    def deal(batches):
        parts, digests, known, held = [], [], set(), 0
        for batch in batches:
            for _, tokens in _sets(batch.column("text")):
                n = len(tokens)
                digest = _digest(tokens) if n else None
                if not n or digest in known:
                    continue
                known.add(digest)
                parts.append(tokens[: n - least_common(n) + extra(n)])
                digests.append(digest)
                held += len(parts[-1])
                if held >= FLUSH or len(parts) == MARK:
                    yield flush(parts, _key(digests))
                    parts, digests, known, held = [], [], set(), 0
        if parts:
            yield flush(parts, _key(digests))

    return deal


def _count_shared(blobs: pa.Table) -> pa.Table:
    """Reduce side: for every set, its shingles of this bucket that another set has as well."""
    tokens, owner, keys, own, own_n, base = [], [], [], [], [], 0
    for row in blobs.to_pylist():
        high = np.frombuffer(row["high"], "<u2").astype(U64)
        tokens.append(high << U64(32) | np.frombuffer(row["low"], "<u4").astype(U64))
        o = np.frombuffer(row["owner"], "<u2").astype(np.int64)
        owner.append(np.where(o == MARK, -1, o + base))
        keys.append(np.frombuffer(row["keys"], "<i8"))
        own.append(np.frombuffer(row["own"], "<u2").astype(np.int64) + base)
        own_n.append(np.frombuffer(row["own_n"], "<u4"))
        base += len(keys[-1])
    names, same = np.unique(np.concatenate(keys), return_inverse=True)
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    owner = np.where(owner < 0, -1, same[owner])
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
    distinct = np.diff(owner, prepend=-2) != 0
    distinct[new] = True
    per_run = np.add.reduceat(distinct.astype(np.int64), new)
    marked = np.minimum.reduceat(owner, new) < 0
    runs = np.diff(np.append(new, len(tokens)))
    hit = np.repeat((per_run > 1) | marked, runs) & (owner >= 0) & distinct
    many = np.bincount(owner[hit], minlength=len(names))
    # A set that several tasks hold settles the same shingles in each; once is enough.
    settled = np.zeros(len(names), np.int64)
    np.maximum.at(settled, same[np.concatenate(own)], np.concatenate(own_n).astype(np.int64))
    many = many + settled
    found = np.flatnonzero(many)
    return pa.table({"node": pa.array(names[found]), "many": pa.array(many[found])})


def partly_shared(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(digest, node, n, rep)`` of the classes that may have a partner.

    ``node`` is the first half of the digest, ``rep`` the smallest id of the class.
    """
    classes = sets.where("digest IS NOT NULL").groupBy("digest").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("rep"))
    classes = cut(classes.withColumn("node", _first_half(F.col("digest"))), "classes")
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(48, tokens * (100 - PERCENT + EXTRA) // 100 // TOKENS_A_BUCKET)
    shared = (
        docs.select("text").mapInArrow(giving_back(_deal(buckets)), BLOB)
        .groupBy("bucket").applyInArrow(_count_shared, "node long, many long")
        .groupBy("node").agg(F.sum("many").alias("many"))
    )
    smallest = F.ceil(F.lit(PERCENT / 100) * F.col("n") - 1e-6)
    least = F.ceil(F.lit(EXTRA / 100) * smallest - 1e-6)
    return cut(classes.join(shared, "node").where(F.col("many") >= least).drop("many"), "shared")


def _first_half(digest):
    hexed = F.hex(digest)
    # Byte by byte the same number as the numpy side: little-endian, signed.
    turned = F.concat(*[F.substring(hexed, 15 - 2 * k, 2) for k in range(8)])
    high, low = F.conv(F.substring(turned, 1, 8), 16, 10), F.conv(F.substring(turned, 9, 8), 16, 10)
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def _tokens_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(digest, node, tokens)``: the sets of ``classes``, read from one of their documents."""

    def read(batches):
        for batch in batches:
            wanted = batch.column("digest").to_pylist()
            rows = [(wanted[k], tokens.tobytes()) for k, tokens in _sets(batch.column("text"))
                    if _digest(tokens) == wanted[k]]
            keys = _key([d for d, _ in rows])
            yield pa.record_batch(
                [pa.array([d for d, _ in rows], pa.binary()), pa.array(keys, pa.int64()),
                 pa.array([t for _, t in rows], pa.binary())], ["digest", "node", "tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = classes.select(F.col("rep").alias("doc_id"), "digest")
    joined = source.alias("l").join(
        small(held, 500_000).alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")))
    return joined.select("l.text", "r.digest").mapInArrow(
        giving_back(read), "digest binary, node long, tokens binary")


def _frequent(held: DataFrame, total: int) -> np.ndarray:
    """Shingles that many sets of a bounded sample have. They only decide the order, and any
    order gives the same links."""

    def read(batches):
        for batch in batches:
            for blob in batch.column("tokens").to_pylist():
                yield pa.record_batch([pa.array(np.frombuffer(blob, np.int64))], ["token"])

    part = F.pmod(F.xxhash64("node"), F.lit(max(1, total // SAMPLED))) == 0
    counted = held.where(part).select("tokens").mapInArrow(giving_back(read), "token long").groupBy("token").count()
    rows = counted.where(F.col("count") >= FREQUENT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(U64))


def _entries(frequent: np.ndarray, buckets: int):
    """Map side of the document frequencies: the less frequent shingles, as arrays per bucket."""

    def flush(parts, nodes):
        tokens = np.concatenate(parts) & LOW48
        owner = np.repeat(np.arange(len(parts), dtype=np.uint16), [len(p) for p in parts])
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        place = ((tokens >> U64(24)) * U64(buckets)) >> U64(24)
        edges = np.searchsorted(place, np.arange(buckets + 1, dtype=U64))
        rows = [(b, tokens[i:k].tobytes(), owner[i:k].tobytes(), np.array(nodes, "<i8").tobytes())
                for b, (i, k) in enumerate(zip(edges[:-1], edges[1:])) if k > i]
        return pa.record_batch([pa.array(c, pa.int32() if k == 0 else pa.binary())
                                for k, c in enumerate(zip(*rows))], ["bucket", "tokens", "owner", "nodes"])

    def deal(batches):
        parts, nodes, held = [], [], 0
        for batch in batches:
            for node, blob in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist()):
                tokens = np.frombuffer(blob, U64)
                parts.append(tokens[~_among(tokens, frequent)])
                nodes.append(node)
                held += len(parts[-1])
                if held >= FLUSH or len(parts) == MARK:
                    if held:
                        yield flush(parts, nodes)
                    parts, nodes, held = [], [], 0
        if held:
            yield flush(parts, nodes)

    return deal


def _shared_with_counts(blobs: pa.Table) -> pa.Table:
    """Reduce side: of every set, the shingles that several sets have, and how many have them."""
    tokens, owner = [], []
    for row in blobs.to_pylist():
        tokens.append(np.frombuffer(row["tokens"], U64))
        owner.append(np.frombuffer(row["nodes"], "<i8")[np.frombuffer(row["owner"], np.uint16)])
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.diff(tokens, prepend=~tokens[:1]) != 0
    once = new | (np.diff(owner, prepend=~owner[:1]) != 0)
    tokens, owner, new = tokens[once], owner[once], np.flatnonzero(new[once])
    runs = np.diff(np.append(new, len(tokens)))
    counts = np.repeat(runs, runs)
    tokens, owner, counts = (x[counts > 1] for x in (tokens, owner, counts))
    order = np.argsort(owner, kind="stable")
    tokens, owner, counts = tokens[order], owner[order], counts[order].astype("<u4")
    names, first = np.unique(owner, return_index=True)
    edges = list(zip(first.tolist(), [*first.tolist()[1:], len(owner)]))
    return pa.table({
        "node": pa.array(names),
        "tokens": pa.array([tokens[i:k].tobytes() for i, k in edges], pa.binary()),
        "counts": pa.array([counts[i:k].tobytes() for i, k in edges], pa.binary())})


def _among(tokens: np.ndarray, sorted_tokens: np.ndarray) -> np.ndarray:
    if not len(sorted_tokens):
        return np.zeros(len(tokens), bool)
    at = np.minimum(np.searchsorted(sorted_tokens, tokens), len(sorted_tokens) - 1)
    return sorted_tokens[at] == tokens


def _prefix_rows(held: DataFrame, frequent: np.ndarray, tokens: int) -> DataFrame:
    """``(token, node)`` of the prefixes: shingles of one set first, then by the number of sets,
    those of ``frequent`` last. Single shingles link nothing and are left out."""
    buckets = max(48, tokens // TOKENS_A_BUCKET)
    lists = (
        held.select("node", "tokens")
        .mapInArrow(giving_back(_entries(frequent, buckets)), "bucket int, tokens binary, owner binary, nodes binary")
        .groupBy("bucket").applyInArrow(_shared_with_counts, "node long, tokens binary, counts binary")
        .groupBy("node").agg(F.collect_list(F.struct("tokens", "counts")).alias("lists"))
    )

    def own(batches):
        for batch in batches:
            n, many, late = [], [], []
            for blob in batch.column("tokens").to_pylist():
                t = np.frombuffer(blob, U64)
                mine = t[_among(t, frequent)]
                n.append(len(t))
                many.append(len(mine))
                late.append((mine[: len(t) - least_common(len(t)) + 1] & LOW48).tobytes())
            yield pa.record_batch([batch.column("node"), pa.array(n, pa.int64()), pa.array(many, pa.int64()),
                                   pa.array(late, pa.binary())], ["node", "n", "many", "late"])

    def prefixes(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = row["lists"] or []
                t = np.concatenate([np.frombuffer(x["tokens"], U64) for x in got] or [np.empty(0, U64)])
                c = np.concatenate([np.frombuffer(x["counts"], "<u4") for x in got] or [np.empty(0, "<u4")])
                single = row["n"] - row["many"] - len(t)
                room = row["n"] - least_common(row["n"]) + 1 - single
                if room <= 0:
                    continue
                first = np.concatenate([t[np.lexsort((t, c))], np.frombuffer(row["late"], U64)])[:room]
                yield pa.record_batch([pa.array(first.view(np.int64)),
                                       pa.array(np.full(len(first), row["node"]))], ["token", "node"])

    sizes = held.select("node", "tokens").mapInArrow(giving_back(own), "node long, n long, many long, late binary")
    return sizes.join(lists, "node", "left").mapInArrow(giving_back(prefixes), "token long, node long")


def candidate_groups(held: DataFrame, total: int, tokens: int) -> DataFrame:
    """``(node, root)``: classes connected through shingles that prefixes share."""
    rows = cut(_prefix_rows(held, _frequent(held, total), tokens), "prefixes")
    shared = cut(
        rows.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first < last").drop("last"), "shared_tokens")
    links = rows.join(shared, "token").where("node <> first")
    return components(links.select(F.col("node").alias("u"), F.col("first").alias("v")))


class Trie:
    """Prefix tree over sorted integer arrays; a chain of single children is one segment."""

    __slots__ = ("segment", "depth", "least", "most", "rows", "ends", "children")

    def __init__(self, sets: list[np.ndarray], rows: list[int], depth: int = 0):
        """``rows``: indices of the sets below this node, in lexicographic order."""
        a, b = sets[rows[0]], sets[rows[-1]]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        end = depth + int(differ[0]) if len(differ) else n
        self.segment, self.depth = a[depth:end], end
        sizes = [len(sets[r]) for r in rows]
        self.least, self.most, self.rows = min(sizes), max(sizes), np.array(rows)
        self.ends = [r for r in rows if len(sets[r]) == end]
        self.children = []
        run: list[int] = []
        for r in rows[len(self.ends):]:
            if run and sets[r][end] != sets[run[-1]][end]:
                self.children.append(Trie(sets, run, end))
                run = []
            run.append(r)
        if run:
            self.children.append(Trie(sets, run, end))


def trie_links(tokens: list[np.ndarray], stored: list[int], walking: list[int],
               known: np.ndarray) -> list[tuple[int, int]]:
    """Links (spanning, not all) between the ``stored`` and the ``walking`` sets.

    ``known``: a number per set; sets with equal numbers are connected already.
    """
    sizes = [len(t) for t in tokens]
    names, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(names))
    bounds = np.cumsum([0, *sizes])
    ranked = rank[inverse]
    sets = [np.sort(ranked[bounds[k] : bounds[k + 1]]) for k in range(len(tokens))]
    tree = Trie(sets, sorted(stored, key=lambda k: sets[k].astype(">i4").tobytes()))
    mine, links, known = np.zeros(len(names), bool), [], known.copy()
    for y in walking:
        m, own = sizes[y], sets[y]
        mine[own] = True
        stack = [(tree, 0)]
        while stack:
            node, common = stack.pop()
            if node.most * 100 < PERCENT * m or PERCENT * node.least > 100 * m:
                continue
            if (known[node.rows] == known[y]).all():
                continue
            if len(node.segment):
                common += int(np.count_nonzero(mine[node.segment]))
                left = m - int(np.searchsorted(own, node.segment[-1], "right"))
            else:
                left = m
            if common + min(node.most - node.depth, left) < needed(node.least, m):
                continue
            for x in node.ends:
                if known[x] != known[y] and common >= needed(sizes[x], m):
                    links.append((x, y))
                    known[known == known[y]] = known[x]
            stack += [(child, common) for child in node.children]
        mine[own] = False
    return links


def _join_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """All trie joins of one task's cell key: ``(grp, i, j)`` is a cell, ``side`` 0 or 1."""
    out = []
    for (_, i, j), rows in cells.groupby(["grp", "i", "j"], sort=False):
        rows = rows.drop_duplicates(["digest", "side"])
        tokens = [np.frombuffer(t, U64) for t in rows["tokens"]]
        side, digests = rows["side"].to_numpy(), rows["digest"].tolist()
        known = pd.factorize(rows["known"])[0]
        everyone = list(range(len(rows)))
        if i == j:
            stored = walking = everyone
        else:
            stored, walking = [k for k in everyone if side[k] == 0], [k for k in everyone if side[k]]
        if stored and walking and len(rows) > 1:
            found = trie_links(tokens, stored, walking, known)
            out += stars((digests[x], digests[y]) for x, y in found)
    return pd.DataFrame(out, columns=["u", "v"])


CELL = ["key", "grp", "i", "j", "side", "known", "digest", "tokens"]


def _links(cells: DataFrame) -> DataFrame:
    return cells.select(*CELL).groupBy("key").applyInPandas(_join_cells, "u binary, v binary")


def _first_cells(held: DataFrame, groups: DataFrame) -> DataFrame:
    """Small groups whole, many to a key; of large ones every chunk with itself and the first."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(groups.join(sizes, "root"), "groups")
    total = sized.count()
    rows = held.join(small(sized, 500_000), "node").withColumns({
        "grp": F.col("root"), "known": F.hex("digest"),
        "chunks": F.ceil(F.col("size") / CHUNK).cast("int")})
    whole = F.col("size") <= 2 * CHUNK
    one = rows.where(whole).withColumns({
        "i": F.lit(0), "j": F.lit(0), "side": F.lit(0),
        "key": F.pmod(F.xxhash64("grp"), F.lit(max(1, total // (2 * CHUNK))))})
    chunk = F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")
    many = rows.where(~whole).withColumn("chunk", chunk)
    others = F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(
        F.array(F.lit(0), F.col("chunk")))
    many = many.withColumn("other", F.explode(others)).withColumns({
        "i": F.least("chunk", "other"), "j": F.greatest("chunk", "other"),
        "side": (F.col("chunk") > 0).cast("int")})
    many = many.withColumn("key", F.xxhash64("grp", "i", "j"))
    return one.select(*CELL).unionByName(many.select(*CELL))


def _further_cells(held: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame | None:
    """Cells for large groups that the first cells left in several components.

    A group is cut anew so that no chunk mixes its largest component with others; chunks of the
    largest meet only the chunks of the rest, and those meet each other.
    """
    known = held.select("node", "digest").join(groups, "node").join(
        found.select(F.col("node").alias("digest"), F.col("root").alias("known")), "digest", "left"
    ).withColumn("known", F.coalesce("known", "digest"))
    sizes = known.groupBy("root", "known").agg(F.count(F.lit(1)).alias("size"))
    by_size = F.struct("size", "known")
    totals = sizes.groupBy("root").agg(
        F.sum("size").alias("total"), F.count(F.lit(1)).alias("parts"), F.max(by_size).alias("top"))
    open_groups = cut(
        totals.where((F.col("total") > 2 * CHUNK) & (F.col("parts") > 1)).select(
            "root", F.col("top.known").alias("largest"),
            F.ceil(F.col("top.size") / CHUNK).cast("int").alias("big"),
            F.ceil((F.col("total") - F.col("top.size")) / CHUNK).cast("int").alias("rest")), "open")
    if open_groups.isEmpty():
        return None
    rows = cut(known.join(small(open_groups), "root"), "rows")
    rows = held.join(small(rows.drop("digest"), 500_000), "node")
    in_rest = F.col("known") != F.col("largest")
    chunk = F.when(in_rest, F.pmod(F.xxhash64("digest"), F.col("rest"))).otherwise(
        F.col("rest") + F.pmod(F.xxhash64("digest"), F.col("big"))).cast("int")
    rows = rows.withColumn("chunk", chunk)
    others = F.when(in_rest, F.sequence(F.lit(0), F.col("rest") + F.col("big") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("rest") - 1))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumns({
        "grp": F.col("root"), "known": F.hex("known"), "i": F.least("chunk", "other"),
        "j": F.greatest("chunk", "other"),
        "side": (F.col("chunk") > F.col("other")).cast("int")}
    ).withColumn("key", F.xxhash64("grp", "i", "j")).select(*CELL)


def similar_classes(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, root)`` of the classes (by digest) that a chain of links joins with others."""
    classes = partly_shared(docs, sets)
    held = cut(_tokens_of(docs, classes), "tokens")
    total, tokens = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = cut(candidate_groups(held, total, tokens), "candidates")
    links = cut(_links(_first_cells(held, groups)), "found")
    found = cut(components(links), "components")
    further = _further_cells(held, groups, found)
    if further is not None:
        known = found.select(F.col("node").alias("u"), F.col("root").alias("v"))
        found = cut(components(known.union(_links(further))), "components")
    return found


def with_components(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, digest)`` of every row of ``docs (doc_id, text)``.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z are lower-cased, a set holds the 5-word
    shingles, of a shorter text its whole sequence. Documents without words, or with a NULL
    text, link with nothing. ``component_id`` is the smallest id reachable; rows whose id is
    NULL link as others do but lend no id. Repeated rows each give a row. An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    sets = cut(shingle_sets(docs), "sets")
    found = similar_classes(docs, sets).select(F.col("node").alias("digest"), "root")
    reps = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = reps.join(small(cut(found, "named"), 500_000), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    # Only linked classes take a smallest id from others.
    linked = named.join(small(cut(found.select("root").distinct(), "roots"), 500_000), "root", "left_semi")
    lowest = linked.groupBy("root").agg(F.min("rep").alias("lowest"))
    names = cut(
        named.join(small(cut(lowest, "lowest"), 500_000), "root", "left").select(
            "digest", F.coalesce("lowest", "rep").alias("component_id"), "root"), "names")
    return sets.join(names, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", F.when(F.col("digest").isNull(), F.col("doc_id"))).alias("component_id"),
        "digest", "root")


def _with_digest(docs: DataFrame, name: str) -> DataFrame:
    place = docs.columns.index("text")

    def read(batches):
        for batch in batches:
            digests = [_digest(t) if len(t) else None for _, t in _sets(batch.column(place))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, name])

    kind = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    return docs.mapInArrow(giving_back(read), kind)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Of repeated rows of that document one stays. Documents without words stay. All columns are
    kept; a component whose ids are all NULL keeps one row.
    """
    rows = cut(with_components(docs).where("digest IS NOT NULL"), "rows")
    keeps = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = cut(rows.groupBy("root").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.when(keeps, F.col("digest"))).alias("kept"),
        F.count(F.when(keeps, 1)).alias("keepers")).where("rows > 1"), "several")
    judged = rows.join(small(several), "root")
    stays = keeps & (F.col("digest") == F.col("kept"))
    dropped = cut(judged.where(~stays).select("doc_id", "digest").distinct(), "dropped")
    doubled = cut(judged.where(stays & (F.col("keepers") > 1)).select("doc_id", "digest").distinct(), "doubled")
    (name,) = unused(docs, "set_digest")
    marked = _with_digest(docs, name)
    match = lambda t: (F.col(f"d.{name}") == t["digest"]) & (
        F.col("d.doc_id").eqNullSafe(t["doc_id"]))
    out = marked.alias("d").join(small(dropped, 500_000), match(dropped), "left_anti")
    if not doubled.isEmpty():
        again = out.alias("d").join(small(doubled, 500_000), match(doubled), "left_semi")
        out = out.alias("d").join(small(doubled, 500_000), match(doubled), "left_anti").union(
            again.dropDuplicates([name, "doc_id"]))
    return out.drop(name)


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark, sf_dir):
    return with_components(table(spark, sf_dir, "documents")).drop("digest", "root")
