from __future__ import annotations

import os

import pytest

from citeweave.plans.core_queries import QUERIES, SQL
from tests import oracle

needs_data = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    oracle.assert_same(spark, QUERIES[name], SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, oracle.DATA)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
