"""Compare registered queries with their SQL: python tests/compare.py SF_DIR NAME... (all without names)."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(map(norm, v)) + "]"
        return repr(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if sql is None:
        return None, f"{len(got)} rows, no SQL, {took:.1f} s"
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = canonical(columns, res.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{len(got)} / {len(want)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return True, f"{len(got)} rows, {took:.1f} s"


def session(cpus="4"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, sqls, all_q = session(), duck(sf), entry.oracle_sql(), entry.queries()
    failed = []
    for n in names or all_q:
        try:
            ok, said = compare(spark, con, n, all_q[n], sqls.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], n, said, flush=True)
        failed += [n] if ok is False else []
    print("failed:", failed)
    spark.stop()
