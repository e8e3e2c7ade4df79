"""Local correctness check: run a query on Spark and its oracle SQL on DuckDB
over the same parquet tables, then compare row count, column names and
order-insensitive values.  Usage: ``python -m rollscope.plans.check [sf_dir] [name ...]``."""
from __future__ import annotations

import math
import sys
import time

import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in sdf.dtypes}
    sp = sdf.toPandas()
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    dk = rel.df()
    t2 = time.time()
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    ok = sc == dc and len(sr) == len(dr) and s_types == d_types
    first_bad = None if s_types == d_types else ("types", s_types, d_types)
    if ok:
        for a, b in zip(sr, dr):
            if a != b:
                ok = False
                first_bad = (a, b)
                break
    return ok, dict(rows=len(sr), oracle_rows=len(dr), cols=sc, oracle_cols=dc, first_bad=first_bad,
                    spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    from rollscope.plans.catalog import ORACLE, QUERIES, load_all
    from rollscope.session import get_spark
    load_all()
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(QUERIES):
        if name not in ORACLE:
            df = QUERIES[name](spark, sf_dir)
            print(f"{name:28s} NO-ORACLE rows={df.count()}")
            continue
        try:
            ok, info = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as e:  # report and continue
            ok, info = False, {"error": repr(e)[:300]}
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} {info}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
