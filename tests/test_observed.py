"""Checks taken while writing against the checks that read."""

import datetime as dt
import os

import pytest

from ledgerline.operators import observed as O
from ledgerline.operators import quality as Q
from ledgerline.operators import rewrite as W


def _orders(spark):
    d = dt.date
    rows = [(1, d(2024, 1, 1), 5), (1, d(2024, 1, 3), 0), (2, d(2024, 1, 3), -1), (None, None, None), (None, d(2024, 1, 9), 7), (4, d(2023, 12, 31), 2)]
    return spark.createDataFrame(rows, "id long, day date, qty int")


def test_observed_equals_read_checks(spark, tmp_out):
    df, parents = _orders(spark), spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long")
    costs = spark.createDataFrame([(1, 3), (2, -2)], "id long, cost int")
    rules = [O.rows("t", 4), O.bounds("day", "2024-01-01", "2024-01-05"), O.covered("day", "2024-01-01", "2024-01-05"),
             *O.not_null("t", ["id", "qty"]), *O.positive("t", ["qty"]), O.unique("t.id", ["id"]),
             O.references("foreign_key:t.id", parents, "id"), O.below("margin", costs, "id", "cost", "qty")]
    got = dict(O.write_observed({"t": df}, os.path.join(tmp_out, "v"), {"t": rules}))
    want = Q.run_checks([
        Q.check_row_count({"t": df}, {"t": 4}), Q.check_date_bounds(df, "day", "2024-01-01", "2024-01-05"),
        Q.check_date_coverage(df, "day", "2024-01-01", "2024-01-05"), Q.check_not_null(df, ["id", "qty"], "t"),
        Q.check_positive(df, ["qty"], "t"), Q.check_unique(df, ["id"], "t.id"), Q.check_foreign_keys([("t.id", df, parents, "id")])])
    assert got == {r["check"]: r["violations"] for r in want.collect()} | {"margin": 1}
    assert O.reread(df, rules) == got
    back = spark.read.parquet(os.path.join(tmp_out, "v", "t"))
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_empty_table(spark, tmp_out):
    df = _orders(spark).where("false")
    rules = [O.rows("t", 2), O.bounds("day", "2024-01-01", "2024-01-05"), O.covered("day", "2024-01-01", "2024-01-05"),
             O.unique("t.id", ["id"]), *O.not_null("t", ["id"])]
    got = dict(O.write_observed({"t": df}, os.path.join(tmp_out, "v"), {"t": rules}))
    assert got == {"row_count:t": 2, "date_bounds": 2, "date_coverage": 5, "unique:t.id": 0, "not_null:t.id": 0}


def test_publish_observed_keeps_the_previous_version(spark, tmp_out):
    base = os.path.join(tmp_out, "tables")
    rules = {"t": [O.unique("t.id", ["id"])]}
    v1 = W.publish_observed({"t": spark.createDataFrame([(1,), (2,)], "id long")}, base, rules)
    with pytest.raises(RuntimeError, match="unique:t.id=1"):
        W.publish_observed({"t": spark.createDataFrame([(1,), (1,)], "id long")}, base, rules)
    assert W.latest_version_path(spark, base) == v1


def test_one_scan_for_each_written_table(spark, tables):
    rules = O.not_null("orders", ["order_id"]) + [O.unique("orders.order_id", ["order_id"]), O.covered("order_date", "1995-01-01", "1995-02-01")]
    wide, _ = O.observed(tables.orders, rules)
    assert wide._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
