"""Queries against their SQL, on documents, benchmark items and vectors."""

import pytest

from readmill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, same_as_sql, name):
    same_as_sql(Q.queries()[name](spark, sf), Q.oracle_sql()[name])
