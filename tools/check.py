"""Run every query and its SQL twin on one data folder and compare the results.

usage: python tools/check.py [folder] [name-part ...]
"""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return type(v).__name__ if not isinstance(v, (list, tuple)) else "list"


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    left = [tuple(norm(row[c]) for c in cols) for row in spark_df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    pick = [names.index(c) for c in cols]
    right = [tuple(norm(row[i]) for i in pick) for row in rel.fetchall()]
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "EMPTY"
    kl, kr = {}, {}
    for rows, kinds in ((left, kl), (right, kr)):
        for row in rows:
            for c, v in zip(cols, row):
                if v is not None and c not in kinds:
                    kinds[c] = kind(v)
    if kl != kr:
        return f"types {kl} vs {kr}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left.sort(key=key), right.sort(key=key)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)}/{len(left)} differ, e.g. {cols} {bad[0]}"[:600] if bad else f"ok {len(left)}"


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    import duckdb

    from tesserae.session import get_spark

    spec = importlib.util.spec_from_file_location("entry_module", "/root/repo/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    sqls = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                verdict = compare(df, con, sqls[name])
            else:
                verdict = f"ok rows-only {df.count()}"
        except Exception as exc:
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        failed += not verdict.startswith("ok")
        print(f"{'  ' if verdict.startswith('ok') else '!!'} {name:34s} {time.time() - t0:6.2f}s {verdict}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
