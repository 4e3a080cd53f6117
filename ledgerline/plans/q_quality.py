"""Data-quality check queries (C1-C13), set checks (U1, U3), FK anti joins (J7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions.text import fold_ascii
from ledgerline.operators import observed as O
from ledgerline.operators import quality as Q
from ledgerline.operators import recipes, rewrite, sales
from ledgerline.plans.q_rewrite import _with_map
from ledgerline.plans.registry import QUERIES, register
from ledgerline.session import checkpoint_dir
from ledgerline.sources import roles

# Fixed expectations of the test data (the order date range of the fixture).
EXPECTED_START = "1995-01-01"
EXPECTED_END = "2001-08-01"
LOOKUP_NAME = "red widget"


# Control totals: what each table must hold, counted from its keys (recipes: lines per product).
@register("check_row_count", f"""
SELECT 'row_count:products' AS "check", abs((SELECT count(*) FROM products) - (SELECT count(DISTINCT p_partkey) FROM part)) AS violations
UNION ALL SELECT 'row_count:orders', abs((SELECT count(*) FROM s_orders) - (SELECT count(DISTINCT o_orderkey) FROM orders))
UNION ALL SELECT 'row_count:order_items', abs((SELECT count(*) FROM order_items)
  - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) l))
UNION ALL SELECT 'row_count:ingredients', abs((SELECT count(*) FROM ingredients) - (SELECT count(DISTINCT s_suppkey) FROM supplier))
UNION ALL SELECT 'row_count:recipe_items', abs((SELECT count(*) FROM recipe_items) - {roles.RECIPE_LINES} * (SELECT count(*) FROM part))""")
def q_check_row_count(t):
    lines = t.raw("part").select(F.explode(F.sequence(F.lit(1), F.lit(roles.RECIPE_LINES))))
    return Q.check_row_count(t.views(), {
        "products": t.raw("part").select("p_partkey").distinct(),
        "orders": t.raw("orders").select("o_orderkey").distinct(),
        "order_items": t.raw("lineitem").select("l_orderkey", "l_linenumber").distinct(),
        "ingredients": t.raw("supplier").select("s_suppkey").distinct(),
        "recipe_items": lines})


@register("check_date_bounds", f"""
SELECT 'date_bounds' AS "check",
  (CASE WHEN min(order_date) IS DISTINCT FROM DATE '{EXPECTED_START}' THEN 1 ELSE 0 END
 + CASE WHEN max(order_date) IS DISTINCT FROM DATE '{EXPECTED_END}' THEN 1 ELSE 0 END) AS violations
FROM s_orders""")
def q_check_date_bounds(t):
    return Q.check_date_bounds(t.orders, "order_date", EXPECTED_START, EXPECTED_END)


_SPINE = f"""(SELECT CAST(d AS DATE) AS day FROM
   unnest(generate_series(DATE '{EXPECTED_START}', DATE '{EXPECTED_END}', INTERVAL 1 DAY)) AS g(d))"""


@register("date_gaps", f"""
SELECT s.day FROM {_SPINE} s
WHERE NOT EXISTS (SELECT 1 FROM s_orders o WHERE o.order_date = s.day)""")
def q_date_gaps(t):
    return Q.date_gaps(t.orders, "order_date", EXPECTED_START, EXPECTED_END)


@register("check_date_coverage", f"""
SELECT 'date_coverage' AS "check", count(*) AS violations FROM {_SPINE} s
WHERE NOT EXISTS (SELECT 1 FROM s_orders o WHERE o.order_date = s.day)""")
def q_check_date_coverage(t):
    return Q.check_date_coverage(t.orders, "order_date", EXPECTED_START, EXPECTED_END)


@register("check_foreign_keys", """
SELECT 'foreign_key:order_items.order_id' AS "check", count(*) AS violations
  FROM order_items i WHERE NOT EXISTS (SELECT 1 FROM s_orders o WHERE o.order_id = i.order_id)
UNION ALL SELECT 'foreign_key:order_items.product_id', count(*)
  FROM order_items i WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)
UNION ALL SELECT 'foreign_key:recipe_items.product_id', count(*)
  FROM recipe_items r WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = r.product_id)
UNION ALL SELECT 'foreign_key:recipe_items.ingredient_id', count(*)
  FROM recipe_items r WHERE NOT EXISTS (SELECT 1 FROM ingredients n WHERE n.ingredient_id = r.ingredient_id)""")
def q_check_foreign_keys(t):
    return Q.check_foreign_keys([
        ("order_items.order_id", t.order_items, t.orders, "order_id"),
        ("order_items.product_id", t.order_items, t.products, "product_id"),
        ("recipe_items.product_id", t.recipe_items, t.products, "product_id"),
        ("recipe_items.ingredient_id", t.recipe_items, t.ingredients, "ingredient_id"),
    ])


@register("join_fk_anti", """
SELECT o.order_id, o.order_date FROM s_orders o
WHERE NOT EXISTS (SELECT 1 FROM order_items i WHERE i.order_id = o.order_id)""")
def q_join_fk_anti(t):
    return Q.orphans(t.orders.select("order_id", "order_date"), t.order_items, "order_id")


def _unique_sql(name: str, table: str, keys: str) -> str:
    return f"""SELECT 'unique:{name}' AS "check", CAST(COALESCE(sum(n - 1), 0) AS BIGINT) AS violations
FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys} HAVING count(*) > 1) d"""


@register("check_unique", " UNION ALL ".join([
    _unique_sql("products.product_id", "products", "product_id"),
    _unique_sql("orders.order_id", "s_orders", "order_id"),
    _unique_sql("ingredients.ingredient_id", "ingredients", "ingredient_id"),
    _unique_sql("recipe_items.product_ingredient", "recipe_items", "product_id, ingredient_id"),
    _unique_sql("products.name_nocase", "products",
                "translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    _unique_sql("order_items.order_line", "order_items", "order_id, line_number"),
    _unique_sql("ingredients.name", "ingredients", "name"),
    _unique_sql("recipe_items.recipe_item_id", "recipe_items", "recipe_item_id"),
]))
def q_check_unique(t):
    return Q.run_checks([
        Q.check_unique(t.products, ["product_id"], "products.product_id"),
        Q.check_unique(t.orders, ["order_id"], "orders.order_id"),
        Q.check_unique(t.ingredients, ["ingredient_id"], "ingredients.ingredient_id"),
        Q.check_unique(t.recipe_items, ["product_id", "ingredient_id"], "recipe_items.product_ingredient"),
        Q.check_unique(t.products, [fold_ascii(F.col("name"))], "products.name_nocase"),
        Q.check_unique(t.order_items, ["order_id", "line_number"], "order_items.order_line"),
        Q.check_unique(t.ingredients, ["name"], "ingredients.name"),
        Q.check_unique(t.recipe_items, ["recipe_item_id"], "recipe_items.recipe_item_id"),
    ])


_NN = {"products": ["product_id", "name", "category", "price_cents"],
       "orders": ["order_id", "order_date", "branch", "payment_method"],
       "order_items": ["order_id", "product_id", "quantity", "unit_price_cents", "unit_cost_cents"],
       "ingredients": ["ingredient_id", "name", "unit", "cost_per_unit_cents"],
       "recipe_items": ["recipe_item_id", "product_id", "ingredient_id", "quantity"]}


def _nn_sql() -> str:
    parts = []
    for table, cols in _NN.items():
        src = "s_orders" if table == "orders" else table
        for c in cols:
            parts.append(f"""SELECT 'not_null:{table}.{c}' AS "check", count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {src}""")
    return " UNION ALL ".join(parts)


@register("check_not_null", _nn_sql())
def q_check_not_null(t):
    views = t.views()
    return Q.run_checks([Q.check_not_null(views[name], cols, name) for name, cols in _NN.items()])


@register("check_positive", """
SELECT 'positive:products.price_cents' AS "check", count(*) FILTER (WHERE price_cents <= 0) AS violations FROM products
UNION ALL SELECT 'positive:order_items.quantity', count(*) FILTER (WHERE quantity <= 0) FROM order_items
UNION ALL SELECT 'positive:order_items.unit_price_cents', count(*) FILTER (WHERE unit_price_cents <= 0) FROM order_items
UNION ALL SELECT 'positive:recipe_items.quantity', count(*) FILTER (WHERE quantity <= 0) FROM recipe_items""")
def q_check_positive(t):
    return Q.run_checks([
        Q.check_positive(t.products, ["price_cents"], "products"),
        Q.check_positive(t.order_items, ["quantity", "unit_price_cents"], "order_items"),
        Q.check_positive(t.recipe_items, ["quantity"], "recipe_items"),
    ])


@register("check_recipe_coverage", """
SELECT 'recipe_coverage' AS "check", count(*) AS violations FROM products p
WHERE NOT EXISTS (SELECT 1 FROM recipe_items r WHERE r.product_id = p.product_id)""")
def q_check_recipe_coverage(t):
    return Q.check_recipe_coverage(t.products, t.recipe_items)


@register("check_margin", """
SELECT 'margin' AS "check", count(*) AS violations
FROM (SELECT r.product_id, round_even(sum(r.quantity * n.cost_per_unit_cents), 0) AS c
      FROM recipe_items r JOIN ingredients n USING (ingredient_id) GROUP BY r.product_id) rc
JOIN products p USING (product_id) WHERE rc.c >= p.price_cents""")
def q_check_margin(t):
    return Q.check_margin(recipes.margin_check(t))


# The names of the whole catalog against the names that were sold.
_SET_A = "SELECT DISTINCT name FROM products"
_SET_B = "SELECT DISTINCT name FROM products WHERE product_id IN (SELECT product_id FROM order_items)"


def _sets(t):
    sold = t.products.join(t.order_items.select("product_id"), "product_id", "left_semi")
    return t.products.select("name").distinct(), sold.select("name").distinct()


@register("set_equal", f"""
SELECT name, 'left_only' AS side FROM ({_SET_A} EXCEPT {_SET_B}) a
UNION ALL SELECT name, 'right_only' FROM ({_SET_B} EXCEPT {_SET_A}) b""")
def q_set_equal(t):
    a, b = _sets(t)
    return Q.set_difference(a, b)


@register("check_catalog_equal", f"""
SELECT 'catalog_equal' AS "check", count(*) AS violations FROM (
  ({_SET_A} EXCEPT {_SET_B}) UNION ALL ({_SET_B} EXCEPT {_SET_A})) d""")
def q_check_catalog_equal(t):
    a, b = _sets(t)
    return Q.check_catalog_equal(a, b)


_COUNTS_SQL = """
SELECT 'products' AS table_name, (SELECT count(*) FROM products) AS rows_before,
       (SELECT count(*) FROM new_products) AS rows_after
UNION ALL SELECT 'order_items', (SELECT count(*) FROM order_items), (SELECT count(*) FROM new_items)
UNION ALL SELECT 'orders', (SELECT count(*) FROM s_orders), (SELECT count(*) FROM s_orders)
UNION ALL SELECT 'ingredients', (SELECT count(*) FROM ingredients), (SELECT count(*) FROM ingredients)
UNION ALL SELECT 'recipe_items', (SELECT count(*) FROM recipe_items), (SELECT count(*) FROM recipe_items)"""


def _repriced(t):
    """All five tables before and after a repricing, which rewrites products and order lines."""
    products, items = rewrite.reprice(t, rewrite.category_price_map(t))
    return t.views(), t.views() | {"products": products, "order_items": items}


@register("before_after_counts", _with_map(_COUNTS_SQL))
def q_before_after_counts(t):
    return Q.before_after_counts(*_repriced(t))


@register("check_counts_kept", _with_map(f"""
SELECT 'counts_kept' AS "check", count(*) FILTER (WHERE rows_before IS DISTINCT FROM rows_after) AS violations
FROM ({_COUNTS_SQL}) c"""))
def q_check_counts_kept(t):
    return Q.check_counts_kept(*_repriced(t))


@register("check_nocase_lookup", f"""
SELECT 'nocase_lookup' AS "check", abs(count(*) - 1) AS violations FROM products
WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = '{LOOKUP_NAME}'""")
def q_check_nocase_lookup(t):
    return Q.check_nocase_lookup(t.products, LOOKUP_NAME)


@register("check_additive", """
SELECT 'additive' AS "check",
  (CASE WHEN y.r IS NOT DISTINCT FROM t.r THEN 0 ELSE 1 END + CASE WHEN y.c IS NOT DISTINCT FROM t.c THEN 0 ELSE 1 END
 + CASE WHEN y.p IS NOT DISTINCT FROM t.p THEN 0 ELSE 1 END) AS violations
FROM (SELECT sum(r) AS r, sum(c) AS c, sum(p) AS p FROM (
        SELECT strftime(o.order_date, '%Y') AS yr, sum(i.quantity * i.unit_price_cents) AS r,
               sum(i.quantity * i.unit_cost_cents) AS c,
               sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)) AS p
        FROM s_orders o JOIN order_items i USING (order_id) GROUP BY 1) yy) y,
     (SELECT sum(quantity * unit_price_cents) AS r, sum(quantity * unit_cost_cents) AS c,
             sum(quantity * (unit_price_cents - unit_cost_cents)) AS p FROM order_items) t""")
def q_check_additive(t):
    return Q.check_additive(sales.yearly_summary(t), sales.totals(t),
                            ["revenue_cents", "estimated_food_cost_cents", "estimated_gross_profit_cents"])


# All checks of the five tables from the pass that writes them (control totals as in check_row_count).
_OBSERVED = ["check_date_bounds", "check_date_coverage", "check_foreign_keys", "check_unique", "check_not_null",
             "check_positive", "check_recipe_coverage", "check_margin"]


def _rules(t) -> dict[str, list[O.Rule]]:
    nn = {name: O.not_null(name, cols) for name, cols in _NN.items()}
    return {
        "products": nn["products"] + O.positive("products", ["price_cents"]) + [
            O.unique("products.product_id", ["product_id"]), O.unique("products.name_nocase", [fold_ascii(F.col("name"))]),
            O.references("recipe_coverage", t.recipe_items, "product_id"),
            O.below("margin", recipes.recipe_cost(t), "product_id", "recipe_cost_cents", "price_cents")],
        "orders": nn["orders"] + [
            O.bounds("order_date", EXPECTED_START, EXPECTED_END), O.covered("order_date", EXPECTED_START, EXPECTED_END),
            O.unique("orders.order_id", ["order_id"])],
        "order_items": nn["order_items"] + O.positive("order_items", ["quantity", "unit_price_cents"]) + [
            O.references("foreign_key:order_items.order_id", t.orders, "order_id"),
            O.references("foreign_key:order_items.product_id", t.products, "product_id"),
            O.unique("order_items.order_line", ["order_id", "line_number"])],
        "ingredients": nn["ingredients"] + [
            O.unique("ingredients.ingredient_id", ["ingredient_id"]), O.unique("ingredients.name", ["name"])],
        "recipe_items": nn["recipe_items"] + O.positive("recipe_items", ["quantity"]) + [
            O.references("foreign_key:recipe_items.product_id", t.products, "product_id"),
            O.references("foreign_key:recipe_items.ingredient_id", t.ingredients, "ingredient_id"),
            O.unique("recipe_items.product_ingredient", ["product_id", "ingredient_id"]),
            O.unique("recipe_items.recipe_item_id", ["recipe_item_id"])],
    }


@register("observed_checks", " UNION ALL ".join(f"SELECT * FROM ({QUERIES[n].oracle}) q_{n}" for n in _OBSERVED), use_roles=False)
def q_observed_checks(t):
    spark = t.orders.sparkSession
    found = O.write_observed(t.views(), f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}", _rules(t))
    return spark.createDataFrame(found, "check string, violations bigint")
