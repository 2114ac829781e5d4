"""Runs registered queries beside their SQL on the same tables and compares the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0) if v != 0 else "0.0"
    if isinstance(v, bool):
        return str(v)
    return "NULL" if v is None else str(v)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_types(df):
    small = {"tinyint", "smallint", "int", "bigint"}
    return {n: "int" if t in small else t for n, t in df.dtypes}


def duck_types(desc):
    kinds = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "double",
             "VARCHAR": "string", "BOOLEAN": "boolean"}
    return {d[0]: kinds.get(str(d[1]), str(d[1])) for d in desc}


def compare(df, con, query):
    """None if both sides agree, else a text that says where they differ."""
    cur = con.execute(query)
    desc = cur.description
    want = cur.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(d[0] for d in desc):
        return f"columns {sorted(df.columns)} != {sorted(d[0] for d in desc)}"
    if spark_types(df) != duck_types(desc):
        a, b = spark_types(df), duck_types(desc)
        return f"types {[(n, a[n], b[n]) for n in a if a[n] != b[n]]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a = _table(df.columns, got)
    b = _table([d[0] for d in desc], want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = make_session()
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                kind = "sql"
            else:
                kind = f"rows={df.count()}"
                problem = None
        except Exception as e:  # keep going: the report lists all queries
            problem, kind = f"{type(e).__name__}: {str(e)[:600]}", "?"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28} {kind:10} "
              f"{time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
