"""Compares a query with its SQL in DuckDB over one folder of tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    return v + 0.0 if isinstance(v, float) else v


def rows(df, columns):
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False, name=None)), key=repr)


def same(spark, sf, make, sql) -> int:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = make(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert a == b
    return len(a)
