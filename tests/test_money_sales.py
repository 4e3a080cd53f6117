import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.money import half_even, money_columns
from ledgerline.functions.text import fold_ascii
from ledgerline.operators import sales


def test_money_columns_values_and_labels(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -150), (4, 1), (5, 99), (6, 100)],
                               "id int, revenue_cents long")
    out, labels = money_columns(df)
    assert labels == ["revenue_pkr"]
    got = {r["id"]: r["revenue_pkr"] for r in out.collect()}
    assert got == {1: None, 2: 0.0, 3: -1.5, 4: 0.01, 5: 0.99, 6: 1.0}


def test_fractional_cents_round_half_even(spark):
    df = spark.createDataFrame([(12.5,), (267.5,), (13.5,), (99.4,), (-12.5,), (None,)], "avg_cents double")
    assert [r[0] for r in money_columns(df)[0].collect()] == [0.12, 2.68, 0.14, 0.99, -0.12, None]


def test_breakdown_category_counts_an_order_once(spark, tables):
    got = {r["category"]: r["orders"] for r in sales.breakdown(tables, "category").collect()}
    j = tables.order_items.join(tables.products.select("product_id", "category"), "product_id")
    want = {r["category"]: r["n"] for r in j.groupBy("category").agg(F.count_distinct("order_id").alias("n")).collect()}
    assert got == want


def test_money_labels_of_empty_result(spark):
    df = spark.createDataFrame([], "a_cents long, b string, c_cents long")
    out, labels = money_columns(df)
    assert labels == ["a_pkr", "c_pkr"] and out.count() == 0


def test_duplicate_names_refused(spark):
    df = spark.createDataFrame([(1, 2)], "x long, y long").toDF("v_cents", "v_cents")
    with pytest.raises(ValueError):
        money_columns(df)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-2.5,), (2.4999,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [0.0, 2.0, 2.0, -2.0, 2.0]


def test_fold_ascii_only(spark):
    df = spark.createDataFrame([("RED WIDGET",), ("Red widget",), ("É",)], "s string")
    got = [r[0] for r in df.select(fold_ascii(F.col("s"))).collect()]
    assert got == ["red widget", "red widget", "É"]


def test_day_summary_golden(tables):
    r = sales.day_summary(tables, "1996-03-01").first()
    assert (r["orders"], r["lines"], r["units"]) == (4, 14, 399)


def test_day_without_orders_gives_zero_row(tables):
    rows = sales.day_summary(tables, "2030-01-01").collect()
    assert len(rows) == 1 and all(v == 0 for v in rows[0])


def test_out_of_range_period_is_empty_not_clamped(tables):
    assert sales.summary(tables, "year", "2030-01-01", "2030-12-31").count() == 0


def test_yearly_rows_add_up_to_totals(tables):
    y = sales.yearly_summary(tables).agg(*[F.sum(m) for m in sales.MEASURES[1:]]).first()
    t = sales.totals(tables).first()
    assert list(y) == list(t)
    assert t["revenue_cents"] - t["estimated_food_cost_cents"] == t["estimated_gross_profit_cents"]


def test_orders_without_lines_count_in_day_but_not_year(tables):
    # 257 orders have no line; the yearly table (inner join) leaves them out
    y = sales.yearly_summary(tables).agg(F.sum("orders")).first()[0]
    assert y == tables.orders.count() - 257


def test_fill_gives_every_day(tables):
    out = sales.summary(tables, "day", "1997-10-20", "1997-10-30", fill=True)
    assert out.count() == 11
    gap = out.where(F.col("day") == dt.date(1997, 10, 25)).first()
    assert gap["orders"] == 0


def test_period_join_matches_brute_force(spark, tables):
    from ledgerline.operators.periods import period_join
    periods = [(1, dt.date(1996, 3, 1), dt.date(1996, 3, 1)), (2, dt.date(1996, 2, 20), dt.date(1996, 4, 5)),
               (3, dt.date(1995, 12, 15), dt.date(1996, 6, 30)), (4, None, dt.date(1996, 1, 1)),
               (5, dt.date(1996, 5, 2), dt.date(1996, 5, 1))]
    pdf = spark.createDataFrame(periods, "pid int, date_start date, date_end date")
    got = sorted((r["pid"], r["order_id"]) for r in period_join(pdf, tables.orders, "order_date").collect())
    orders = [(r["order_id"], r["order_date"]) for r in tables.orders.collect()]
    want = sorted((pid, oid) for pid, s, e in periods if s and e for oid, d in orders if s <= d <= e)
    assert got == want


def test_period_blocks_match_brute_force(spark):
    """Blocks of random periods: their days, each once, and no more than two blocks per level."""
    import datetime as dt
    import random

    from ledgerline.operators import periods as P
    r = random.Random(3)
    lo, hi = dt.date(1999, 12, 30), dt.date(2003, 5, 6)
    days = [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]
    rows = [(i, *sorted(r.choice(days) + dt.timedelta(days=r.randint(-40, 40)) for _ in range(2))) for i in range(150)]
    rows += [(200, lo, hi), (201, lo, lo), (202, hi, hi), (203, hi, lo), (204, None, hi), (205, lo, None), (206, dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    asked = spark.createDataFrame(rows, "pid int, date_start date, date_end date")
    got, n = {}, {}
    for x in P.with_blocks(asked, "date_start", "date_end", lo, hi).collect():
        got.setdefault(x["pid"], []).extend(range(x["_at"] << x["_level"], (x["_at"] + 1) << x["_level"]))
        n[x["pid"], x["_level"]] = n.get((x["pid"], x["_level"]), 0) + 1
    for pid, s, e in rows:
        want = [i for i, d in enumerate(days) if s and e and s <= d <= e]
        assert sorted(got.get(pid, [])) == want
    assert max(n.values()) <= 2
    facts = spark.createDataFrame([(d, r.randint(1, 9)) for d in days if r.random() < 0.6] + [(None, 99)], "d date, n int")
    held = [(f["d"], f["n"]) for f in facts.collect() if f["d"]]
    top = {x["pid"]: x["n"] for x in P.period_aggregate(asked, facts, "d", {"n": F.max}, "pid").collect()}
    inside = {pid: [v for d, v in held if s and e and s <= d <= e] for pid, s, e in rows}
    assert top == {pid: max(v) for pid, v in inside.items() if v}
    pairs = P.period_join(asked, facts, "d", salts=3).groupBy("pid").count().collect()
    assert {x["pid"]: x["count"] for x in pairs} == {pid: len(v) for pid, v in inside.items() if v}
    assert P.period_join(asked, facts.where("n > 100"), "d").count() == 0 == P.period_aggregate(
        asked, facts.where("n > 100"), "d", {"n": F.max}, "pid").count()


def test_period_joins_never_broadcast_many_periods(spark):
    """The periods look small to the planner, but each grows into many rows: the calendar's side is broadcast, or none."""
    from ledgerline.operators import periods as P
    first = F.lit(dt.date(1996, 1, 1))
    facts = spark.range(2_000_000).select(F.date_add(first, (F.col("id") % 400).cast("int")).alias("d"), F.col("id").alias("n"))
    daily = facts.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.range(2000).select(F.col("id").alias("pid"), F.date_add(first, (F.col("id") % 300).cast("int")).alias("date_start"),
                                     F.date_add(first, (F.col("id") % 300 + F.col("id") % 7).cast("int")).alias("date_end"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    top, few, many = P.period_aggregate(asked, daily, "d", {"n": F.max}, "pid"), P.period_join(asked, daily, "d"), P.period_join(asked, facts, "d")
    assert not any("BuildLeft" in plan(x) for x in (top, few, many))
    assert "SortMergeJoin" in plan(many)
    days = sum(i % 7 + 1 for i in range(2000))
    assert few.count() == days and many.where("n < 400").count() == days and top.count() == 2000


def test_category_tasks_are_bounded_by_rows(tables, monkeypatch):
    """More lines make more parts: no task holds more than its share of the lines, whatever the shuffle settings."""
    want = sorted(map(tuple, sales.breakdown(tables, "category").collect()))
    monkeypatch.setattr(sales, "ROWS_PER_TASK", 2000, raising=False)
    df = sales.breakdown(tables, "category")
    assert sorted(map(tuple, df.collect())) == want
    assert "hashpartitioning(order_id" in (plan := df._jdf.queryExecution().executedPlan().toString()) and ", 30), REPARTITION_BY_NUM" in plan
