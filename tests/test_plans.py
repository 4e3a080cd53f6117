"""Plan-shape guards: the plans we rely on at scale."""

import pytest

import __spark_entry__ as E
from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
ITERATIVE = {"weighted_sample_distinct"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.all_queries() if n not in ITERATIVE))
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_day_filter_reaches_the_scan(spark):
    from ledgerline.operators import sales
    from ledgerline.sources import roles
    df = sales.day_summary(roles.load(spark, SF), "1996-03-01")
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(o_orderdate,1996-03-01T00:00)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_discount:double>" in text
    assert "LeftSemi" in text


@pytest.mark.parametrize("name", ["vector_top_k", "text_top_k", "top_products"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "WindowGroupLimit" in p or "TakeOrderedAndProject" in p
