"""Queries against their SQL."""

import pytest
from oracle_check import compare, oracle

from skysift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toArrow()
    assert compare(got, oracle(SF).execute(ORACLES[name]).to_arrow_table()).startswith("ok")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() == 5
