"""Sales summaries over the order / order-line star.

Shape of every summary plan (see ``summary``):

    order_items --partial agg--> shuffle(order_id) --final agg--+
                                                                 +-- join(order_id) -- partial agg by period -- small shuffle
    orders (filter pushed to the scan) ----- shuffle(order_id) --+

Lines are reduced to one row per order *before* the join, so the join reads
about one row per order from each side and reuses the ``order_id``
partitioning of the aggregate (no extra exchange). Counting orders is then a
plain ``count(*)`` at period level: an order has one date, so no
``count(distinct)`` row expansion is needed.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import as_date
from ledgerline.sources.roles import Tables

MEASURES = ("units", "revenue_cents", "estimated_food_cost_cents", "estimated_gross_profit_cents")
# Lines that one task reduces to (order, category), about.
ROWS_PER_TASK = 500_000


def line_measures() -> list[Column]:
    """Per-line amounts in cents (bigint arithmetic, exact)."""
    q = F.col("quantity")
    return [
        q.alias("units"),
        (q * F.col("unit_price_cents")).alias("revenue_cents"),
        (q * F.col("unit_cost_cents")).alias("estimated_food_cost_cents"),
        (q * (F.col("unit_price_cents") - F.col("unit_cost_cents"))).alias("estimated_gross_profit_cents"),
    ]


def order_measures(items: DataFrame) -> DataFrame:
    """One row per order: line count and the summed measures."""
    return (items.select("order_id", *line_measures())
            .groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("lines"), *[F.sum(m).alias(m) for m in MEASURES]))


def period_key(by: str) -> Column:
    if by == "year":
        return F.date_format("order_date", "yyyy").alias("year")
    if by == "month":
        return F.date_format("order_date", "yyyy-MM").alias("month")
    if by == "day":
        return F.col("order_date").alias("day")
    return F.col(by)


def filter_period(orders: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive ``order_date BETWEEN start AND end`` (either bound optional)."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("order_date") >= as_date(start))
    if end is not None:
        cond = cond & (F.col("order_date") <= as_date(end))
    return orders.where(cond) if (start is not None or end is not None) else orders


def summary(t: Tables, by: str = "year", start=None, end=None, fill: bool = False) -> DataFrame:
    """Orders, units, revenue, food cost and gross profit per period.

    ``by`` is ``year`` (text ``yyyy``), ``month`` (``yyyy-MM``), ``day``
    (date), ``category`` (of the product; an order counts once in each of its
    categories) or any orders column (``branch``, ``payment_method``). Inner join:
    orders without lines drop out, as in the reference's yearly table.
    Only periods with rows are returned unless ``fill`` asks for a zero row
    on every day / month of the requested range.
    """
    orders = filter_period(t.orders, start, end)
    per_order = order_measures(_lines_of(t, orders, start, end)).join(orders, "order_id")
    if by == "category":
        return _by_category(t, _lines_of(t, orders, start, end), orders)
    key = period_key(by)
    out = (per_order.groupBy(key)
           .agg(F.count(F.lit(1)).alias("orders"), *[F.sum(m).alias(m) for m in MEASURES]))
    if fill and by in ("day", "month"):
        if start is None or end is None:
            raise ValueError("fill=True needs both start and end")
        from ledgerline.operators.generate import date_spine
        spine = date_spine(t.spark, start, end).select(F.col("day").alias("order_date")).select(period_key(by)).distinct()
        name = spine.columns[0]
        out = (spine.join(out, name, "left")
               .select(name, F.coalesce("orders", F.lit(0)).alias("orders"),
                       *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES]))
    return out


def _by_category(t: Tables, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Measures per product category of the lines of ``orders``. Lines get their category, meet their orders and are
    reduced to (order, category), so an order with two products of a category counts once. They are shuffled by
    order into parts of about ROWS_PER_TASK lines: a task's hash tables stay as small whatever the number of lines."""
    parts = -(-items.count() // ROWS_PER_TASK) or 1
    named = items.join(t.products.select("product_id", "category"), "product_id").select("order_id", "category", *line_measures())
    known = named.repartition(parts, "order_id").join(orders.select("order_id"), "order_id", "left_semi")
    once = known.groupBy("category", "order_id").agg(*[F.sum(m).alias(m) for m in MEASURES])
    return once.groupBy("category").agg(F.count(F.lit(1)).alias("orders"), *[F.sum(m).alias(m) for m in MEASURES])


def _lines_of(t: Tables, orders: DataFrame, start=None, end=None) -> DataFrame:
    """Order lines, reduced to the orders of a period when one is given.

    With a date filter the (few) matching order ids semi-join the lines
    before any aggregation, so a one-day request does not aggregate every
    line of the table; AQE broadcasts the id list when it is small.
    """
    if start is None and end is None:
        return t.order_items
    return t.order_items.join(orders.select("order_id"), "order_id", "left_semi")


def yearly_summary(t: Tables) -> DataFrame:
    return summary(t, "year")


def monthly_summary(t: Tables, start=None, end=None) -> DataFrame:
    return summary(t, "month", start, end)


def daily_summary(t: Tables, start=None, end=None) -> DataFrame:
    return summary(t, "day", start, end)


def breakdown(t: Tables, by: str = "branch", start=None, end=None) -> DataFrame:
    return summary(t, by, start, end)


def totals(t: Tables) -> DataFrame:
    """Grand revenue, cost and gross profit in cents (one row)."""
    return t.order_items.select(*line_measures()).agg(*[F.sum(m).alias(m) for m in MEASURES[1:]])


def day_summary(t: Tables, day) -> DataFrame:
    """One day: orders (with or without lines), lines, and measures.

    Left join, so an order with no line still counts; a day with no orders
    still gives one row of zeros (global aggregate, sums COALESCEd).
    """
    o = filter_period(t.orders, day, day).select("order_id")
    per_order = order_measures(_lines_of(t, o, day, day))
    j = o.join(per_order, "order_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES],
    )


def period_revenue(t: Tables, start, end) -> DataFrame:
    o = filter_period(t.orders, start, end).select("order_id")
    items = _lines_of(t, o, start, end).select("order_id", (F.col("quantity") * F.col("unit_price_cents")).alias("r"))
    return items.agg(F.sum("r").alias("revenue_cents"))


def sales_lines(t: Tables, ordered: bool = False) -> DataFrame:
    """Denormalised sales line with money in currency units (export layout)."""
    i = t.order_items
    j = i.join(t.orders, "order_id").join(t.products.select("product_id", "name"), "product_id")
    q = F.col("quantity")
    p = F.col("unit_price_cents")
    c = F.col("unit_cost_cents")
    out = j.select(
        "order_id", "line_number", "order_date", "branch", "payment_method", "name", "quantity",
        (p.cast("double") / 100).alias("unit_price_pkr"),
        (c.cast("double") / 100).alias("estimated_unit_food_cost_pkr"),
        ((q * p).cast("double") / 100).alias("revenue_pkr"),
        ((q * c).cast("double") / 100).alias("estimated_food_cost_pkr"),
        ((q * (p - c)).cast("double") / 100).alias("estimated_gross_profit_pkr"),
    )
    return out.orderBy("order_id", "line_number") if ordered else out


def basket_quote(t: Tables, baskets: DataFrame | None = None) -> DataFrame:
    """Selling price of baskets: SUM(qty * current product price) per basket.

    ``baskets`` has (basket_id, product_id, quantity); by default every order
    is re-quoted at today's menu prices.
    """
    if baskets is None:
        baskets = t.order_items.select(F.col("order_id").alias("basket_id"), "product_id", "quantity")
    priced = baskets.join(t.products.select("product_id", "price_cents"), "product_id")
    return (priced.groupBy("basket_id")
            .agg(F.sum("quantity").alias("units"),
                 F.sum(F.col("quantity") * F.col("price_cents")).alias("quote_cents")))


def top_products(t: Tables, n: int = 20) -> DataFrame:
    """The ``n`` products with the highest revenue (ties: lower id first)."""
    rev = (t.order_items
           .groupBy("product_id")
           .agg(F.sum(F.col("quantity") * F.col("unit_price_cents")).alias("revenue_cents"),
                F.sum("quantity").alias("units")))
    return (rev.join(t.products.select("product_id", "name"), "product_id")
            .orderBy(F.col("revenue_cents").desc(), F.col("product_id"))
            .limit(n))


def date_range(t: Tables) -> DataFrame:
    """MIN and MAX order date (one row)."""
    return t.orders.agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


def count_distinct(t: Tables) -> DataFrame:
    """Days with orders, products sold and orders with lines: one distinct each, never a row per combination."""
    lines = t.order_items.select("order_id", "product_id").join(t.orders.select("order_id"), "order_id", "left_semi")
    products = lines.select("product_id").distinct().select(F.count(F.lit(1)).alias("n")).scalar()
    sold = t.orders.join(lines.select("order_id").distinct(), "order_id")
    days = sold.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.count_if(F.col("order_date").isNotNull()).alias("order_days"), products.alias("products_sold"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("orders_with_lines"))


def today(offset_hours: int = 5) -> _dt.date:
    """Current date at a fixed UTC offset (no DST)."""
    return (_dt.datetime.now(_dt.timezone.utc) + _dt.timedelta(hours=offset_hours)).date()
