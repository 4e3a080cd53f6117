"""Rewrite queries: reprice by name map, correlated line update, default column, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import rewrite
from ledgerline.plans.registry import register

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PRICE_MAP_SQL = """price_map AS (
  SELECT DISTINCT upper(name) AS name, CAST(50000 + 100 * length(upper(name)) AS BIGINT) AS value
  FROM products),
new_products AS (
  SELECT p.product_id, p.name, p.category, COALESCE(m.value, p.price_cents) AS price_cents
  FROM products p LEFT JOIN (SELECT {fk} AS k, max(value) AS value FROM price_map GROUP BY 1) m
    ON {fp} = m.k),
new_items AS (
  SELECT i.order_id, i.product_id, i.line_number, i.quantity, np.price_cents AS unit_price_cents, i.unit_cost_cents
  FROM order_items i LEFT JOIN new_products np USING (product_id))
""".format(fk=_FOLD.format("name"), fp=_FOLD.format("p.name"))


def _with_map(body: str) -> str:
    return ",\n" + PRICE_MAP_SQL + body


@register("update_from_map", _with_map("SELECT * FROM new_products"))
def q_update_from_map(t):
    products, _ = rewrite.reprice(t, rewrite.category_price_map(t))
    return products


# Price lists as maps: every product brings one for its name in capitals and in reverse.
MAP_LIST_SQL = """price_rows AS (
  SELECT upper(name) AS name, CAST(60000 + 7 * product_id AS BIGINT) AS value FROM products
  UNION ALL SELECT reverse(name), CAST(1 AS BIGINT) FROM products WHERE upper(name) <> reverse(name))"""


def _price_lists(t):
    price = (60000 + 7 * F.col("product_id")).cast("bigint")
    one = F.create_map(F.upper("name"), price)
    back = F.when(F.upper("name") != F.reverse("name"), F.create_map(F.reverse("name"), F.lit(1).cast("bigint")))
    return t.products.select(F.coalesce(F.map_concat(one, back), one).alias("prices"))


@register("map_to_rows", ",\n" + MAP_LIST_SQL + " SELECT name, value FROM price_rows")
def q_map_to_rows(t):
    return rewrite.map_rows(_price_lists(t), "prices")


@register("update_from_maps", ",\n" + MAP_LIST_SQL + f"""
SELECT p.product_id, p.name, p.category, COALESCE(m.value, p.price_cents) AS price_cents
FROM products p LEFT JOIN (SELECT {_FOLD.format("name")} AS k, max(value) AS value FROM price_rows GROUP BY 1) m
  ON {_FOLD.format("p.name")} = m.k""")
def q_update_from_maps(t):
    return rewrite.update_from_maps(t.products, _price_lists(t), "prices", "name", "price_cents")


@register("update_correlated", _with_map("SELECT * FROM new_items"))
def q_update_correlated(t):
    _, items = rewrite.reprice(t, rewrite.category_price_map(t))
    return items


@register("repriced_revenue", _with_map("""
SELECT CAST(sum(quantity * unit_price_cents) AS BIGINT) AS revenue_cents,
       count(*) FILTER (WHERE unit_price_cents IS NULL) AS lines_without_price
FROM new_items"""))
def q_repriced_revenue(t):
    _, items = rewrite.reprice(t, rewrite.category_price_map(t))
    return items.agg(F.sum(F.col("quantity") * F.col("unit_price_cents")).alias("revenue_cents"),
                     F.count_if(F.col("unit_price_cents").isNull()).alias("lines_without_price"))


@register("add_column_default", """
SELECT product_id, name, category, price_cents, CAST(0 AS BIGINT) AS cost_per_unit_cents FROM products""")
def q_add_column_default(t):
    once = rewrite.add_column_default(t.products, "cost_per_unit_cents", 0)
    return rewrite.add_column_default(once, "cost_per_unit_cents", 0)  # second call: unchanged


# Upsert binding: the stored table holds the customers of nations 0-16, the
# batch those of nations 8-24 with a changed balance; nation 24 appears twice
# in the batch (positions 1 and 2) and the later copy wins.
UPSERT_SQL = """
old AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey <= 16),
batch AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, 1 AS pos FROM customer WHERE c_nationkey >= 8
  UNION ALL
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 2, 2 FROM customer WHERE c_nationkey = 24),
last AS (SELECT c_custkey, arg_max(c_name, pos) AS c_name, arg_max(c_nationkey, pos) AS c_nationkey,
                arg_max(c_acctbal, pos) AS c_acctbal FROM batch GROUP BY c_custkey)
"""


def upsert_inputs(t):
    c = t.raw("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    old = c.where(F.col("c_nationkey") <= 16)
    batch = (c.where(F.col("c_nationkey") >= 8).withColumn("c_acctbal", F.col("c_acctbal") + 1)
             .withColumn("pos", F.lit(1))
             .unionByName(c.where(F.col("c_nationkey") == 24).withColumn("c_acctbal", F.col("c_acctbal") + 2)
                          .withColumn("pos", F.lit(2))))
    return old, batch


@register("upsert_by_key", "WITH " + UPSERT_SQL + """
SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM last)
UNION ALL SELECT * FROM last""", use_roles=False)
def q_upsert_by_key(t):
    old, batch = upsert_inputs(t)
    return rewrite.upsert_by_key(old, batch, "c_custkey", order_col="pos")
