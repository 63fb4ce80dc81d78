"""Queries that SQL can express, against the independent engine."""

import pytest

from leeward.llm.catalog import llm_queries, llm_sql
from parity import difference, engine

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_sql(spark, name):
    theirs = engine(FOLDER).execute(llm_sql()[name]).df()
    assert difference(llm_queries()[name](spark, FOLDER).toPandas(), theirs) is None
