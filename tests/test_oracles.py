"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare
from skysift import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
NAMES = list(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    assert compare(got, con.execute(ORACLES[name]).to_arrow_table()).startswith("ok")


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 240


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
