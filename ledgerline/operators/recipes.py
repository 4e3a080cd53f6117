"""Recipe bill of materials: lines, costs, theoretical ingredient use.

Dimension joins (products, ingredients) are left to Catalyst/AQE: they become
broadcast hash joins when the dimension is measured small and sort-merge
joins otherwise -- no unconditional broadcast hint on a table that grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import half_even
from ledgerline.functions.text import fold_ascii
from ledgerline.sources.roles import Tables


def recipe_lines(t: Tables) -> DataFrame:
    """menu item, ingredient, quantity, unit; ordered by product then line."""
    r = t.recipe_items
    p = t.products.select("product_id", F.col("name").alias("menu_item"))
    n = t.ingredients.select("ingredient_id", F.col("name").alias("ingredient"), "unit")
    return (r.join(p, "product_id").join(n, "ingredient_id")
            .select("product_id", "recipe_item_id", "menu_item", "ingredient", "quantity", "unit"))


def recipe_of_item(t: Tables, name: str) -> DataFrame:
    """Every recipe line of the products named ``name`` (ASCII case-insensitive).

    Never limited; when several products carry the name, all of them are
    returned (use ``answers.resolve_names`` to ask which one is meant).
    """
    lines = recipe_lines(t)
    return lines.where(fold_ascii(F.col("menu_item")) == fold_ascii(F.lit(name)))


def recipe_cost(t: Tables) -> DataFrame:
    """Per product: SUM(recipe qty x ingredient cost), half-even to whole cents."""
    r = t.recipe_items.join(t.ingredients.select("ingredient_id", "cost_per_unit_cents"), "ingredient_id")
    return (r.groupBy("product_id")
            .agg(half_even(F.sum(F.col("quantity") * F.col("cost_per_unit_cents"))).cast("bigint")
                 .alias("recipe_cost_cents")))


def margin_check(t: Tables) -> DataFrame:
    """Products whose recipe cost is not below the selling price."""
    return (recipe_cost(t).join(t.products.select("product_id", "name", "price_cents"), "product_id")
            .where(F.col("recipe_cost_cents") >= F.col("price_cents")))


def product_margins(t: Tables) -> DataFrame:
    """Price, recipe cost and margin per product."""
    return (recipe_cost(t).join(t.products.select("product_id", "name", "price_cents"), "product_id")
            .select("product_id", "name", "price_cents", "recipe_cost_cents",
                    (F.col("price_cents") - F.col("recipe_cost_cents")).alias("margin_cents")))


def ingredient_consumption(t: Tables, start=None, end=None) -> DataFrame:
    """Theoretical use: SUM(sold qty x recipe qty) by ingredient AND unit.

    Sales are reduced to one row per product first (partial aggregation
    before the shuffle), so the BOM join sees one row per product, not one
    per sales line. Quantities of different units are never added.
    """
    from ledgerline.operators.sales import filter_period

    items = t.order_items
    if start is not None or end is not None:
        items = items.join(filter_period(t.orders, start, end).select("order_id"), "order_id")
    sold = items.groupBy("product_id").agg(F.sum("quantity").alias("sold"))
    use = sold.join(t.recipe_items, "product_id")
    n = t.ingredients.select("ingredient_id", F.col("name").alias("ingredient"), "unit")
    return (use.groupBy("ingredient_id")
            .agg(F.sum(F.col("sold") * F.col("quantity")).alias("consumed_quantity"))
            .join(n, "ingredient_id")
            .select("ingredient_id", "ingredient", "unit", "consumed_quantity"))


def distinct_ingredient_names(t: Tables) -> DataFrame:
    """Names of the ingredients used by any recipe, sorted."""
    used = t.recipe_items.select("ingredient_id").distinct()
    return (used.join(t.ingredients.select("ingredient_id", "name"), "ingredient_id")
            .select("name").distinct().orderBy("name"))
