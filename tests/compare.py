"""Run registered queries against their SQL twins on one sample folder.

Usage: python tests/compare.py [folder] [name-part ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def same(spark, con, fn, sql, folder):
    """(ok, message): equal columns, row count and values."""
    df = fn(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} / {theirs[0]}", len(mine[1])
    if len(mine[1]) != len(theirs[1]):
        return False, f"rows {len(mine[1])} / {len(theirs[1])}", len(mine[1])
    for i, name in enumerate(mine[0]):
        kinds = [{type(r[i]) for r in rows if r[i] is not None} for rows in (mine[1], theirs[1])]
        if kinds[0] != kinds[1]:
            return False, f"types of {name}: {kinds}", len(mine[1])
    bad = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    if bad:
        a, b = set(mine[1]), set(theirs[1])
        return False, f"{len(bad)} differ; mine only {sorted(a - b, key=str)[:3]}, theirs only {sorted(b - a, key=str)[:3]}", len(mine[1])
    return True, "", len(mine[1])


def main():
    from newsloom import checks
    from newsloom.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          **{"spark.driver.memory": "16g", "spark.ui.enabled": "false",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, fn in checks.QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        begin = time.time()
        try:
            if name in checks.ORACLES:
                ok, text, n = same(spark, con, fn, checks.ORACLES[name], folder)
            else:
                n = fn(spark, folder).count()
                ok, text = True, "rows only"
        except Exception as e:  # report and go on
            ok, text, n = False, f"{type(e).__name__}: {str(e)[:1500]}", -1
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {time.time() - begin:.1f}s {'' if ok else text}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
