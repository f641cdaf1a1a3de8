"""Runs a query on Spark and its SQL on DuckDB and compares rows, columns and values."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.10g}")
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, folder, query, sql):
    """None if equal, else what differs."""
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows: {[x for x in zip(got[1], want[1]) if x[0] != x[1]][:1]}"
    bad = [x for x in zip(got[1], want[1], strict=True) if x[0] != x[1]]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else None
