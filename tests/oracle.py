"""Compares a query with its DuckDB SQL on the benchmark tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if hasattr(value, "year") else value if value is None or isinstance(value, (str, bool)) else round(float(value), 6) + 0.0


def same(df, sql, sf_dir):
    """The rows of both sides as sorted lists, columns by name."""
    answer = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(answer.columns)
    names = sorted(df.columns)
    mine = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=str)
    other = sorted(([plain(r[answer.columns.index(c)]) for c in names] for r in answer.fetchall()), key=str)
    assert mine == other and mine
