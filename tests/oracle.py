"""Comparing a query with its SQL in DuckDB."""

import glob
import os

import duckdb


def database(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def rows(frame, columns):
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, clean.itertuples(index=False, name=None)))


def assert_same(df, sql, sf):
    want, got = database(sf).sql(sql).df(), df.toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
