"""Sales queries: summaries, totals, filters, joins, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.money import money_columns
from ledgerline.functions.text import fold_ascii
from ledgerline.operators import sales
from ledgerline.operators.answers import empty_flag
from ledgerline.plans.registry import register

# Fixed request values used by the registered queries.
ONE_DAY = "1996-03-01"
EMPTY_DAY = "2030-01-01"
JUNE = ("1996-06-01", "1996-06-30")
NAME_ASKED = "RED WIDGET"
BRANCH_ASKED = "1-URGENT"

_MEASURES_SQL = """
  CAST(sum(i.quantity) AS BIGINT) AS units,
  CAST(sum(i.quantity * i.unit_price_cents) AS BIGINT) AS revenue_cents,
  CAST(sum(i.quantity * i.unit_cost_cents) AS BIGINT) AS estimated_food_cost_cents,
  CAST(sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)) AS BIGINT) AS estimated_gross_profit_cents
"""


def _summary_sql(key: str, alias: str, where: str = "") -> str:
    return f"""
SELECT {key} AS {alias}, count(DISTINCT o.order_id) AS orders, {_MEASURES_SQL}
FROM s_orders o JOIN order_items i USING (order_id) {where}
GROUP BY {key}"""


@register("yearly_summary", _summary_sql("strftime(o.order_date, '%Y')", "year"))
def q_yearly_summary(t):
    return sales.yearly_summary(t)


@register("yearly_report", f"""
SELECT year, orders, units,
       round(CAST(revenue_cents AS DOUBLE) / 100, 2) AS revenue_pkr,
       round(CAST(estimated_food_cost_cents AS DOUBLE) / 100, 2) AS estimated_food_cost_pkr,
       round(CAST(estimated_gross_profit_cents AS DOUBLE) / 100, 2) AS estimated_gross_profit_pkr
FROM ({_summary_sql("strftime(o.order_date, '%Y')", "year")}) s""")
def q_yearly_report(t):
    df, _labels = money_columns(sales.yearly_summary(t))
    return df


@register("monthly_summary", _summary_sql("strftime(o.order_date, '%Y-%m')", "month"))
def q_monthly_summary(t):
    return sales.monthly_summary(t)


@register("daily_summary", _summary_sql("o.order_date", "day"))
def q_daily_summary(t):
    return sales.daily_summary(t)


@register("breakdown_branch", _summary_sql("o.branch", "branch"))
def q_breakdown_branch(t):
    return sales.breakdown(t, "branch")


@register("breakdown_payment", _summary_sql("o.payment_method", "payment_method"))
def q_breakdown_payment(t):
    return sales.breakdown(t, "payment_method")


@register("breakdown_category", """
SELECT p.category, count(DISTINCT o.order_id) AS orders, CAST(sum(i.quantity) AS BIGINT) AS units,
       CAST(sum(i.quantity * i.unit_price_cents) AS BIGINT) AS revenue_cents,
       CAST(sum(i.quantity * i.unit_cost_cents) AS BIGINT) AS estimated_food_cost_cents,
       CAST(sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)) AS BIGINT) AS estimated_gross_profit_cents
FROM s_orders o JOIN order_items i USING (order_id) JOIN products p USING (product_id) GROUP BY p.category""")
def q_breakdown_category(t):
    return sales.breakdown(t, "category")


@register("totals", """
SELECT CAST(sum(quantity * unit_price_cents) AS BIGINT) AS revenue_cents,
       CAST(sum(quantity * unit_cost_cents) AS BIGINT) AS estimated_food_cost_cents,
       CAST(sum(quantity * (unit_price_cents - unit_cost_cents)) AS BIGINT) AS estimated_gross_profit_cents
FROM order_items""")
def q_totals(t):
    return sales.totals(t)


def _day_sql(day: str) -> str:
    return f"""
SELECT count(DISTINCT o.order_id) AS orders, count(i.order_id) AS lines,
       CAST(COALESCE(sum(i.quantity), 0) AS BIGINT) AS units,
       CAST(COALESCE(sum(i.quantity * i.unit_price_cents), 0) AS BIGINT) AS revenue_cents,
       CAST(COALESCE(sum(i.quantity * i.unit_cost_cents), 0) AS BIGINT) AS estimated_food_cost_cents,
       CAST(COALESCE(sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)), 0) AS BIGINT)
         AS estimated_gross_profit_cents
FROM s_orders o LEFT JOIN order_items i ON i.order_id = o.order_id
WHERE o.order_date = DATE '{day}'"""


@register("day_summary", _day_sql(ONE_DAY))
def q_day_summary(t):
    return sales.day_summary(t, ONE_DAY)


@register("day_summary_no_orders", _day_sql(EMPTY_DAY))
def q_day_summary_empty(t):
    return sales.day_summary(t, EMPTY_DAY)


@register("period_revenue", f"""
SELECT CAST(sum(i.quantity * i.unit_price_cents) AS BIGINT) AS revenue_cents
FROM order_items i JOIN s_orders o USING (order_id)
WHERE o.order_date BETWEEN DATE '{JUNE[0]}' AND DATE '{JUNE[1]}'""")
def q_period_revenue(t):
    return sales.period_revenue(t, *JUNE)


@register("date_range", "SELECT min(order_date) AS first_date, max(order_date) AS last_date FROM s_orders")
def q_date_range(t):
    return sales.date_range(t)


@register("count_distinct", """
SELECT count(DISTINCT o.order_date) AS order_days, count(DISTINCT i.product_id) AS products_sold,
       count(DISTINCT o.order_id) AS orders_with_lines
FROM s_orders o JOIN order_items i USING (order_id)""")
def q_count_distinct(t):
    return sales.count_distinct(t)


@register("count_rows", """
SELECT 'products' AS table_name, count(*) AS row_count FROM products
UNION ALL SELECT 'orders', count(*) FROM s_orders
UNION ALL SELECT 'order_items', count(*) FROM order_items
UNION ALL SELECT 'ingredients', count(*) FROM ingredients
UNION ALL SELECT 'recipe_items', count(*) FROM recipe_items""")
def q_count_rows(t):
    from ledgerline.operators.quality import count_rows
    return count_rows(t.views())


@register("basket_quote", """
SELECT i.order_id AS basket_id, CAST(sum(i.quantity) AS BIGINT) AS units,
       CAST(sum(i.quantity * p.price_cents) AS BIGINT) AS quote_cents
FROM order_items i JOIN products p USING (product_id)
GROUP BY i.order_id""")
def q_basket_quote(t):
    return sales.basket_quote(t)


@register("top_products", """
SELECT r.product_id, r.revenue_cents, r.units, p.name
FROM (SELECT product_id, CAST(sum(quantity * unit_price_cents) AS BIGINT) AS revenue_cents,
             CAST(sum(quantity) AS BIGINT) AS units
      FROM order_items GROUP BY product_id) r
JOIN products p USING (product_id)
ORDER BY r.revenue_cents DESC, r.product_id
LIMIT 20""")
def q_top_products(t):
    return sales.top_products(t, 20)


@register("sales_lines", """
SELECT i.order_id, i.line_number, o.order_date, o.branch, o.payment_method, p.name, i.quantity,
       CAST(i.unit_price_cents AS DOUBLE) / 100 AS unit_price_pkr,
       CAST(i.unit_cost_cents AS DOUBLE) / 100 AS estimated_unit_food_cost_pkr,
       CAST(i.quantity * i.unit_price_cents AS DOUBLE) / 100 AS revenue_pkr,
       CAST(i.quantity * i.unit_cost_cents AS DOUBLE) / 100 AS estimated_food_cost_pkr,
       CAST(i.quantity * (i.unit_price_cents - i.unit_cost_cents) AS DOUBLE) / 100 AS estimated_gross_profit_pkr
FROM order_items i JOIN s_orders o USING (order_id) JOIN products p USING (product_id)""")
def q_sales_lines(t):
    return sales.sales_lines(t)


@register("menu_list", """
SELECT product_id, name, category, CAST(price_cents AS DOUBLE) / 100 AS selling_price_pkr
FROM products ORDER BY product_id""")
def q_menu_list(t):
    p = t.products
    return p.select("product_id", "name", "category",
                    (F.col("price_cents").cast("double") / 100).alias("selling_price_pkr")).orderBy("product_id")


@register("ingredient_costs", """
SELECT ingredient_id, name, unit, CAST(cost_per_unit_cents AS DOUBLE) / 100 AS sample_cost_per_unit_pkr
FROM ingredients""")
def q_ingredient_costs(t):
    return t.ingredients.select("ingredient_id", "name", "unit",
                                (F.col("cost_per_unit_cents").cast("double") / 100)
                                .alias("sample_cost_per_unit_pkr"))


@register("filter_equals", f"SELECT * FROM s_orders WHERE order_date = DATE '{ONE_DAY}'")
def q_filter_equals(t):
    return t.orders.where(F.col("order_date") == F.lit(ONE_DAY).cast("date"))


@register("filter_period", f"""
SELECT * FROM s_orders WHERE order_date BETWEEN DATE '{JUNE[0]}' AND DATE '{JUNE[1]}'""")
def q_filter_period(t):
    # Named parameters, bound by Spark, as the reference binds them.
    import datetime as dt
    return t.spark.sql(
        "SELECT * FROM {o} WHERE order_date BETWEEN :date_start AND :date_end",
        args={"date_start": dt.date.fromisoformat(JUNE[0]), "date_end": dt.date.fromisoformat(JUNE[1])},
        o=t.orders)


@register("filter_nocase", f"""
SELECT product_id, name, category, price_cents FROM products
WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    = translate('{NAME_ASKED}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')""")
def q_filter_nocase(t):
    return t.products.where(fold_ascii(F.col("name")) == fold_ascii(F.lit(NAME_ASKED)))


@register("filter_attribute", f"SELECT * FROM s_orders WHERE branch = '{BRANCH_ASKED}'")
def q_filter_attribute(t):
    return t.orders.where(F.col("branch") == BRANCH_ASKED)


@register("in_set", """
SELECT product_id, name, category,
       CASE WHEN category IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized'
            WHEN category IN ('PROMO') THEN 'promotion' ELSE 'other' END AS category_group
FROM products WHERE category IN ('SMALL', 'MEDIUM', 'LARGE', 'PROMO')""")
def q_in_set(t):
    sized = ["SMALL", "MEDIUM", "LARGE"]
    promo = ["PROMO"]
    c = F.col("category")
    return (t.products.where(c.isin(*(sized + promo)))
            .select("product_id", "name", "category",
                    F.when(c.isin(*sized), "sized").when(c.isin(*promo), "promotion")
                    .otherwise("other").alias("category_group")))


@register("join_inner_2", """
SELECT o.order_id, o.order_date, i.product_id, i.quantity
FROM s_orders o JOIN order_items i USING (order_id)""")
def q_join_inner_2(t):
    return t.orders.join(t.order_items, "order_id").select("order_id", "order_date", "product_id", "quantity")


@register("join_inner_star", """
SELECT i.order_id, o.order_date, o.branch, p.name, p.category, i.quantity
FROM order_items i JOIN s_orders o USING (order_id) JOIN products p USING (product_id)""")
def q_join_inner_star(t):
    return (t.order_items.join(t.orders, "order_id").join(t.products, "product_id")
            .select("order_id", "order_date", "branch", "name", "category", "quantity"))


@register("join_left_outer", """
SELECT o.order_id, count(i.order_id) AS lines
FROM s_orders o LEFT JOIN order_items i ON i.order_id = o.order_id
GROUP BY o.order_id""")
def q_join_left_outer(t):
    per_order = t.order_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    return (t.orders.select("order_id").join(per_order, "order_id", "left")
            .select("order_id", F.coalesce("lines", F.lit(0)).alias("lines")))


@register("is_empty_result", f"""
SELECT 'year_2030' AS probe, (SELECT count(*) = 0 FROM s_orders o JOIN order_items i USING (order_id)
    WHERE o.order_date BETWEEN DATE '2030-01-01' AND DATE '2030-12-31') AS is_empty
UNION ALL SELECT 'june_revenue', (SELECT sum(i.quantity * i.unit_price_cents) IS NULL
    FROM order_items i JOIN s_orders o USING (order_id)
    WHERE o.order_date BETWEEN DATE '{JUNE[0]}' AND DATE '{JUNE[1]}')
UNION ALL SELECT 'revenue_2030', (SELECT sum(i.quantity * i.unit_price_cents) IS NULL
    FROM order_items i JOIN s_orders o USING (order_id)
    WHERE o.order_date BETWEEN DATE '2030-01-01' AND DATE '2030-12-31')
UNION ALL SELECT 'yearly', (SELECT count(*) = 0 FROM s_orders o JOIN order_items i USING (order_id))""")
def q_is_empty_result(t):
    probes = [
        ("year_2030", sales.summary(t, "year", "2030-01-01", "2030-12-31")),
        ("june_revenue", sales.period_revenue(t, *JUNE)),
        ("revenue_2030", sales.period_revenue(t, "2030-01-01", "2030-12-31")),
        ("yearly", sales.yearly_summary(t)),
    ]
    out = None
    for name, df in probes:
        one = empty_flag(df).select(F.lit(name).alias("probe"), "is_empty")
        out = one if out is None else out.unionByName(one)
    return out
