import hashlib
import re
from collections import Counter

from flowverdict.llm import licenses as x


def plain(text):
    out = re.sub(r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved).*$", " ", (text or "").lower())
    for said, meant in x.SPELLINGS:
        out = out.replace(said, meant)
    out = re.sub(r"[\W_]+", " ", out).strip(" ")
    return hashlib.sha256(out.encode()).hexdigest() if out else None


KNOWN = {plain(t): n for n, t in x.LICENCES}


def test_scan(spark, documents, hard):
    mit, bsd = x.LICENCES[0][1], x.LICENCES[4][1]
    rows = hard + [
        (20, mit), (21, "Copyright (c) 1999 A. Nother\n" + mit.upper()), (22, mit.replace("\n", "  ").replace('"', "“")),
        (23, bsd.replace("License", "Licence")), (24, mit + " Extra terms."), (25, "a\nReleased under the MIT Licence\nb"),
        (26, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, version 2.0"), (27, "(c) me"),
    ]
    out = x.scanned(documents(rows, ["digest", "licence"]), x.default_licences(spark)).collect()
    want = Counter()
    for i, t in rows:
        lines = {KNOWN.get(plain(line)) for line in (t or "").split("\n")} - {None}
        want[i, plain(t), KNOWN.get(plain(t)), ",".join(sorted(lines))] += 1
    assert Counter(map(tuple, out)) == want
    found = {r["doc_id"]: r["licence"] for r in out}
    assert [found[k] for k in range(20, 28)] == ["MIT"] * 3 + ["BSD-3-Clause"] + [None] * 4
    assert {r["doc_id"]: r["notices"] for r in out}[26] == "Apache-2.0 notice,CC-BY-NC-4.0 notice"


def test_empty_tables(spark, documents):
    assert x.scanned(documents([]), x.default_licences(spark)).count() == 0
    none = spark.createDataFrame([], "licence string, text string")
    assert x.scanned(documents([(1, "MIT License")]), none).first()["licence"] is None
