"""Runs named queries next to their SQL twins in DuckDB and compares whole results.

Usage: python tests/parity.py [sf] [key-prefix ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(dtype):
    k = dtype.kind
    return {"i": f"int{dtype.itemsize}", "f": "float", "O": "object", "b": "bool", "M": "time", "U": "object"}.get(k, k)


def canon(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda x: "nan" if pd.isna(x) else repr(float(x) + 0.0))
        else:
            df[c] = df[c].map(lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and pd.isna(x)) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(sdf, ddf):
    """None when equal, else what differs."""
    if sorted(sdf.columns) != sorted(ddf.columns):
        return f"columns {sorted(sdf.columns)} vs {sorted(ddf.columns)}"
    kinds = {c: (kind(sdf[c].dtype), kind(ddf[c].dtype)) for c in sdf.columns if kind(sdf[c].dtype) != kind(ddf[c].dtype)}
    if len(sdf) != len(ddf):
        return f"rows {len(sdf)} vs {len(ddf)} {kinds or ''}"
    if kinds and len(sdf):
        return f"types {kinds}"
    a, b = canon(sdf), canon(ddf)
    diff = (a != b)
    if diff.any().any():
        bad = diff.any(axis=1)
        cols = list(diff.columns[diff.any()])
        return f"{bad.sum()} of {len(a)} rows differ in {cols}\n{a[bad].head(4).to_string()}\n{b[bad].head(4).to_string()}"
    return None


def check(spark, con, sf_dir, key, fn, sql):
    df = fn(spark, sf_dir)
    types = dict(df.dtypes)
    sdf = df.toPandas()
    if sql is None:
        return None if len(df.columns) and len(sdf) else "no rows"
    rel = con.sql(sql)
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    dt = {c: names.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    off = {c: (types[c], dt.get(c)) for c in types if types[c] != dt.get(c)}
    ddf = rel.df()
    if off:
        return f"schema spark/duck {off}"
    for c, t in types.items():
        if t == "date":
            sdf[c] = pd.to_datetime(sdf[c]).dt.strftime("%Y-%m-%d")
            ddf[c] = pd.to_datetime(ddf[c]).dt.strftime("%Y-%m-%d")
    return compare(sdf, ddf)


def main():
    import __spark_entry__ as e
    from shelfwise.session import get_session
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    spark = get_session("parity", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    orc, bad, n = e.oracle_sql(), [], 0
    for k, fn in e.queries().items():
        if args[1:] and not any(k.startswith(p) for p in args[1:]):
            continue
        n += 1
        t0 = time.time()
        try:
            r = check(spark, con, sf_dir, k, fn, orc.get(k))
        except Exception as x:  # report and go on
            r = f"{type(x).__name__}: {str(x)[:700]}"
        dt = time.time() - t0
        if r or dt > 8:
            print(f"{'FAIL' if r else 'slow'} {k} {dt:.1f}s {r or ''}", flush=True)
        if r:
            bad.append(k)
    print(f"{n} checked, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
