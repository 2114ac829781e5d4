"""Plain versions of the corpus operators, for small inputs."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def shingle_set(text, size=5):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(rows):
    """{row number: smallest id reachable} by comparing all pairs of ``rows`` (id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(top(k), []).append(i)
    return [min((i for i in low[top(k)] if i is not None), default=None) for k in range(len(rows))]
