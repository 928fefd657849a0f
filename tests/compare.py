"""Run queries beside their reference SQL: ``python tests/compare.py [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in rows)


def spark_rows(df):
    return normal([tuple(r) for r in df.collect()], df.columns)


def sql_rows(con, sql):
    rel = con.sql(sql)
    return normal(rel.fetchall(), rel.columns)


def main() -> int:
    from evistrata.plans import all_queries, reference_sql
    from evistrata.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = local_session(), connection(sf_dir), []
    oracle = reference_sql()
    for name, fn in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            columns, rows = spark_rows(fn(spark, sf_dir))
        except Exception as exc:
            bad.append(name)
            print(f"ERR   {name}: {str(exc)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
            continue
        took = time.time() - start
        if name not in oracle:
            print(f"rows  {name} {len(rows)} {took:.1f}s", flush=True)
            continue
        try:
            want_columns, want = sql_rows(con, oracle[name])
        except Exception as exc:
            bad.append(name)
            print(f"SQL   {name}: {str(exc)[:600]}", flush=True)
            continue
        if columns == want_columns and rows == want and rows:
            print(f"ok    {name} {len(rows)} {took:.1f}s", flush=True)
            continue
        bad.append(name)
        only, missing = sorted(set(rows) - set(want)), sorted(set(want) - set(rows))
        print(f"DIFF  {name} rows {len(rows)}/{len(want)} columns {columns} {want_columns}", flush=True)
        for tag, part in (("spark", only), ("sql", missing)):
            for row in part[:3]:
                print(f"      {tag}: {row[:300]}")
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
