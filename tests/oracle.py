"""Compares a query with its DuckDB SQL on the tables of a folder."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    want = con.sql(sql)
    names = sorted(want.columns)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == names
    at = [want.columns.index(n) for n in names]
    show = lambda v: f"{v:.12g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[n]) for n in names] for r in df.collect()) == sorted([show(r[k]) for k in at] for r in want.fetchall())
