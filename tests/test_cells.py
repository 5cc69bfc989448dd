"""Nested cells against the flat tables they stand for."""

import pytest
from pyspark.sql import functions as F

from skysift.operators import cells as E
from skysift.operators import detect
from skysift.operators import model as D
from skysift.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def same(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_nesting_is_the_stored_layout(spark):
    bands = ["b02", "b03", "b04", "b08"]
    keys = ["scene_id", "y", "x"]
    assert same(E.nest(X.px10(spark, SF), 6, bands).select(*keys, *bands), X.cells10(spark, SF).select(*keys, *bands))
    assert same(E.nest(X.px20(spark, SF), 3, list(X.TWENTY)).select(*keys, *X.TWENTY), X.cells20(spark, SF).select(*keys, *X.TWENTY))
    assert same(E.unnest(X.cells10(spark, SF), 6, bands).select(*keys, *bands), X.px10(spark, SF).select(*keys, *bands))


def test_stacks_are_those_of_flat_tables(spark):
    flat = X.px10(spark, SF), X.px20(spark, SF), X.px60(spark, SF, placed=True)
    nested = X.cells10(spark, SF), X.cells20(spark, SF), flat[2]
    assert same(detect.fine_stack(*flat), E.fine_stack(*nested))
    assert same(D.feature_stack(*flat, X.OFFSET, X.QUANT), E.feature_stack(*nested, X.OFFSET, X.QUANT))


def test_ragged_cells_are_an_error(spark):
    px = X.px10(spark, SF)
    torn = px.filter("not (y = 7 and x = 7)")
    twice = px.unionByName(px.filter("y = 7 and x = 7"))
    for wrong in (torn, twice):
        with pytest.raises(Exception, match="ragged cell"):
            E.nest(wrong, 6, ["b02"]).agg(F.count("b02"), F.max(F.element_at("b02", 1))).collect()


def test_one_row_a_cell_is_sorted(spark):
    """Both joins use one key: each side is sorted at most once, before any pixel is unfolded."""
    stack = E.fine_stack(X.cells10(spark, SF), X.cells20(spark, SF), X.px60(spark, SF, placed=True))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stack._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Sort [") <= 3 and plan.count("SortMergeJoin") == 2
    assert plan.index("Generate") < plan.index("SortMergeJoin")
