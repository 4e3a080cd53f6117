"""Recipe (bill of materials) queries."""

from __future__ import annotations

from ledgerline.operators import recipes
from ledgerline.plans.registry import register

ITEM_ASKED = "red widget"

_LINES_SQL = """
SELECT r.product_id, r.recipe_item_id, p.name AS menu_item, n.name AS ingredient, r.quantity, n.unit
FROM recipe_items r JOIN products p USING (product_id) JOIN ingredients n USING (ingredient_id)"""

_COST_SQL = """
SELECT r.product_id, CAST(round_even(sum(r.quantity * n.cost_per_unit_cents), 0) AS BIGINT) AS recipe_cost_cents
FROM recipe_items r JOIN ingredients n USING (ingredient_id)
GROUP BY r.product_id"""


@register("join_bom", _LINES_SQL + " ORDER BY r.product_id, r.recipe_item_id")
def q_join_bom(t):
    return recipes.recipe_lines(t).orderBy("product_id", "recipe_item_id")


@register("recipe_of_item", f"""
SELECT * FROM ({_LINES_SQL}) l
WHERE translate(menu_item, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = '{ITEM_ASKED}'""")
def q_recipe_of_item(t):
    return recipes.recipe_of_item(t, ITEM_ASKED)


@register("recipe_cost", _COST_SQL)
def q_recipe_cost(t):
    return recipes.recipe_cost(t)


@register("margin_check", f"""
SELECT c.product_id, c.recipe_cost_cents, p.name, p.price_cents
FROM ({_COST_SQL}) c JOIN products p USING (product_id)
WHERE c.recipe_cost_cents >= p.price_cents""")
def q_margin_check(t):
    return recipes.margin_check(t)


@register("product_margins", f"""
SELECT c.product_id, p.name, p.price_cents, c.recipe_cost_cents, p.price_cents - c.recipe_cost_cents AS margin_cents
FROM ({_COST_SQL}) c JOIN products p USING (product_id)""")
def q_product_margins(t):
    return recipes.product_margins(t)


@register("ingredient_consumption", """
SELECT u.ingredient_id, n.name AS ingredient, n.unit, u.consumed_quantity
FROM (SELECT r.ingredient_id, sum(s.sold * r.quantity) AS consumed_quantity
      FROM (SELECT product_id, sum(quantity) AS sold FROM order_items GROUP BY product_id) s
      JOIN recipe_items r USING (product_id)
      GROUP BY r.ingredient_id) u
JOIN ingredients n USING (ingredient_id)""")
def q_ingredient_consumption(t):
    return recipes.ingredient_consumption(t)


@register("distinct_names", """
SELECT DISTINCT n.name FROM (SELECT DISTINCT ingredient_id FROM recipe_items) r
JOIN ingredients n USING (ingredient_id) ORDER BY n.name""")
def q_distinct_names(t):
    return recipes.distinct_ingredient_names(t)
