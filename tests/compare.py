"""Runs a query and its SQL and compares the rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, str):
        return v
    return int(v) if float(v).is_integer() else round(float(v), 6)


def rows(frame):
    columns = sorted(frame.columns)
    return Counter(tuple(map(value, r)) for r in frame[columns].astype(object).itertuples(index=False))


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"create view {t} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    return con.sql(sql).df()


def assert_same(spark, query, sql: str, sf_dir: str):
    got, want = query(spark, sf_dir).toPandas(), expected(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b))[:3], list((b - a))[:3])
