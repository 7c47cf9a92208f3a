"""Runs a query and its SQL side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def rows(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = df.collect()
    r = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, got) == rows(r.columns, r.fetchall())
    return len(got)
