"""Role binding: the driver tables seen as the sales / recipe star schema.

    products      <- part       (id, name, category, price in cents)
    orders        <- orders     (id, calendar date, branch, payment method)
    order_items   <- lineitem   (order, product, quantity, frozen unit price
                                 and unit cost in cents)
    ingredients   <- supplier   (id, name, unit, cost per unit in cents)
    recipe_items  <- derived from part x supplier (three lines per product)

All columns are derived with column expressions only, so Catalyst prunes the
scans to the columns a query uses and pushes filters into Parquet.

The order-line money is taken from the line itself (no join to ``part``), as
the reference freezes price and cost on each line: a sales summary never has
to join the product dimension.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.money import to_cents

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Fixed values of the binding (ours, stated once).
#   ingredient unit by s_suppkey % 3            -> g, ml, piece
#   ingredient cost per unit in cents            = 1 + s_suppkey % 50
#   recipe line k in 0, 1, 2 of product p uses ingredient (3p + 7k) % n_suppliers
#   recipe quantity                              = ((p + k) % 5 + 1) * 0.5
#   estimated unit food cost                     = 60 % of the discounted unit price
UNITS = ("g", "ml", "piece")
RECIPE_LINES = 3
RECIPE_STRIDE = 7
FOOD_COST_PERCENT = 60


@dataclass
class Tables:
    """Lazily bound role DataFrames over one folder of Parquet tables."""

    spark: SparkSession
    base: str
    _raw: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.base}/{name}.parquet")
        return self._raw[name]

    # ---- sales star -------------------------------------------------------
    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            to_cents(F.col("p_retailprice")).alias("price_cents"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_orderpriority").alias("branch"),
            F.col("o_orderstatus").alias("payment_method"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        unit = F.col("l_extendedprice") * 100 / F.col("l_quantity")
        cost = F.col("l_extendedprice") * (1 - F.col("l_discount")) * FOOD_COST_PERCENT / F.col("l_quantity")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            F.round(unit).cast("bigint").alias("unit_price_cents"),
            F.round(cost).cast("bigint").alias("unit_cost_cents"),
        )

    # ---- recipe bill of materials -----------------------------------------
    @cached_property
    def ingredients(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").alias("ingredient_id"),
            F.col("s_name").alias("name"),
            F.element_at(F.array(*[F.lit(u) for u in UNITS]),
                         (F.col("s_suppkey") % len(UNITS) + 1).cast("int")).alias("unit"),
            (F.col("s_suppkey") % 50 + 1).alias("cost_per_unit_cents"),
        )

    @cached_property
    def recipe_items(self) -> DataFrame:
        # The supplier count is a scalar subquery: one value, planned once.
        n_sup = self.raw("supplier").select(F.count(F.lit(1))).scalar()
        p = self.raw("part").select("p_partkey")
        k = F.explode(F.sequence(F.lit(0), F.lit(RECIPE_LINES - 1))).alias("k")
        return (p.select("p_partkey", k)
                .select(
                    (F.col("p_partkey") * RECIPE_LINES + F.col("k")).alias("recipe_item_id"),
                    F.col("p_partkey").alias("product_id"),
                    ((F.col("p_partkey") * RECIPE_LINES + F.col("k") * RECIPE_STRIDE) % n_sup)
                    .alias("ingredient_id"),
                    (((F.col("p_partkey") + F.col("k")) % 5 + 1) * 0.5).alias("quantity"),
                ))

    def views(self) -> dict[str, DataFrame]:
        return {
            "products": self.products,
            "orders": self.orders,
            "order_items": self.order_items,
            "ingredients": self.ingredients,
            "recipe_items": self.recipe_items,
        }


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir.rstrip("/"))


# The same binding as SQL text, for the DuckDB oracles and for guarded SELECTs
# written against the role names. ``s_orders`` avoids shadowing ``orders``.
ROLE_CTES_SQL = f"""
products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
         CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents
  FROM part),
s_orders AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
         o_orderpriority AS branch, o_orderstatus AS payment_method
  FROM orders),
order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit_price_cents,
         CAST(round(l_extendedprice * (1 - l_discount) * {FOOD_COST_PERCENT} / l_quantity) AS BIGINT)
           AS unit_cost_cents
  FROM lineitem),
ingredients AS (
  SELECT s_suppkey AS ingredient_id, s_name AS name,
         CASE s_suppkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' ELSE 'piece' END AS unit,
         s_suppkey % 50 + 1 AS cost_per_unit_cents
  FROM supplier),
recipe_items AS (
  SELECT p_partkey * 3 + k AS recipe_item_id, p_partkey AS product_id,
         (p_partkey * 3 + k * 7) % (SELECT count(*) FROM supplier) AS ingredient_id,
         CAST((p_partkey + k) % 5 + 1 AS DOUBLE) * 0.5 AS quantity
  FROM part, (SELECT unnest([0, 1, 2]) AS k) ks)
"""


def with_roles(body: str) -> str:
    """Prefix an oracle query with the role CTEs."""
    return "WITH " + ROLE_CTES_SQL.strip() + "\n" + body
