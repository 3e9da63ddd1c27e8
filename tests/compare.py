"""Spark results against DuckDB's for registered queries."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def text(v):
        if v is None or pd.isna(v):
            return "null"
        return str(int(v)) if isinstance(v, float) and v == int(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


def same(spark, data, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    got, want = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
