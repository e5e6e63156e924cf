"""Runs a query beside its SQL over the same tables."""

from __future__ import annotations

import os

import duckdb

from tests.conftest import rows_of

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    connection = duckdb.connect()
    for name in os.listdir(folder):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return connection


def assert_same(spark, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    answer = connect(folder).sql(sql)
    columns = sorted(answer.columns)
    assert sorted(df.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    expected = sorted((tuple(r[p] for p in places) for r in answer.fetchall()), key=lambda r: tuple((v is not None, repr(v)) for v in r))
    assert rows_of(df) == expected
