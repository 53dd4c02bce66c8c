"""Run registered queries next to their SQL texts and compare every value.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def records(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v).__name__ == "bool"), str(v)) for v in r))


def compare(spark, con, run, text, sf_dir):
    """None when equal, else what differs; ('rows', n) is always returned second."""
    df = run(spark, sf_dir)
    got = records(df.columns, [tuple(r) for r in df.collect()])
    if text is None:
        return None, len(got)
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    want = records(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {got[:3]} vs {want[:3]}", len(got)
    for g, w in zip(got, want):
        if g != w or any(type(a) is not type(b) for a, b in zip(g, w)):
            return f"{sorted(names)}\n    spark {g}\n    sql   {w}", len(got)
    return None, len(got)


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from ledgerlark.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", 8)
    con = connect(sf_dir)
    texts, bad = oracle_sql(), 0
    for name, run in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        t0 = time.time()
        try:
            diff, n = compare(spark, con, run, texts.get(name), sf_dir)
        except Exception as e:  # a broken query must not hide the others
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += diff is not None
        state = "ok" if diff is None and name in texts else "rows only" if diff is None else "DIFFERS"
        print(f"{state:9} {name:28} rows={n} {time.time() - t0:5.1f}s {diff or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
