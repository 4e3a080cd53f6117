"""Seeded-draw queries over the orders and the menu: spine, weighted choice, exact mix, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import generate as G
from ledgerline.operators import recipes, sales
from ledgerline.plans.registry import register

SEED = 70002027


def _u_sql(key_sql: str) -> str:
    return f"CAST(('0x' || substr(md5('{SEED}|' || {key_sql}), 1, 8)) AS BIGINT)"


def _choice_sql(u: str, choices) -> str:
    total = sum(w for _, w in choices)
    parts, cum = [], 0
    for value, w in choices:
        cum += w
        v = f"'{value}'" if isinstance(value, str) else str(value)
        parts.append(f"WHEN {u} * {total} < {cum * G.TWO32} THEN {v}")
    return "CASE " + " ".join(parts) + " END"


@register("date_spine", """
SELECT CAST(d AS DATE) AS day
FROM (SELECT unnest(generate_series((SELECT min(order_date) FROM s_orders), (SELECT max(order_date) FROM s_orders),
                                    INTERVAL 1 DAY)) AS d) g""")
def q_date_spine(t):
    rng = sales.date_range(t)
    return G.date_spine(t.spark, rng.select("first_date").scalar(), rng.select("last_date").scalar())


@register("weighted_choice", f"""
SELECT order_id,
       {_choice_sql(_u_sql("'branch|' || order_id"), G.BRANCHES)} AS branch,
       {_choice_sql(_u_sql("'pay|' || order_id"), G.PAYMENTS)} AS payment_method
FROM s_orders""")
def q_weighted_choice(t):
    o = t.orders
    return o.select(
        "order_id",
        G.weighted_choice(G.uniform32(SEED, F.concat(F.lit("branch|"), F.col("order_id"))), G.BRANCHES)
        .alias("branch"),
        G.weighted_choice(G.uniform32(SEED, F.concat(F.lit("pay|"), F.col("order_id"))), G.PAYMENTS)
        .alias("payment_method"))


@register("fixed_mix_shuffle", f"""
SELECT order_id, CASE WHEN rn <= n * 2 // 5 THEN 1 WHEN rn <= n * 2 // 5 + n // 5 THEN 2 ELSE 3 END AS size
FROM (SELECT order_id, row_number() OVER (ORDER BY {_u_sql('order_id')}, order_id) AS rn,
             (SELECT count(*) FROM s_orders) AS n FROM s_orders) r""")
def q_fixed_mix_shuffle(t):
    return G.fixed_mix_shuffle(t.orders.select("order_id"), "order_id", SEED)


def _menu(t):
    """Products with a sampling weight (1 + id % 12), price and recipe cost."""
    cost = recipes.recipe_cost(t).withColumnRenamed("recipe_cost_cents", "unit_cost_cents")
    return (t.products.join(cost, "product_id")
            .select("product_id", "price_cents", "unit_cost_cents",
                    (F.col("product_id") % 12 + 1).alias("weight")))


SAMPLE_SQL = f"""
sized AS (
  SELECT order_id, CASE WHEN rn <= n * 2 // 5 THEN 1 WHEN rn <= n * 2 // 5 + n // 5 THEN 2 ELSE 3 END AS size
  FROM (SELECT order_id, row_number() OVER (ORDER BY {_u_sql('order_id')}, order_id) AS rn,
               (SELECT count(*) FROM s_orders) AS n FROM s_orders) r),
menu AS (SELECT p.product_id, p.product_id % 12 + 1 AS w FROM products p
         WHERE p.product_id IN (SELECT product_id FROM recipe_items)),
cumw AS (SELECT product_id, sum(w) OVER (ORDER BY product_id) AS hi, sum(w) OVER (ORDER BY product_id) - w AS lo FROM menu),
draws AS (SELECT s.order_id, s.size, d,
                 ({_u_sql("CAST(s.order_id AS VARCHAR) || '|' || d")} * (SELECT sum(w) FROM menu)) // {G.TWO32} AS x
          FROM sized s, (SELECT unnest(range(0, 64)) AS d) dd),
picked AS (SELECT dr.order_id, dr.size, c.product_id, min(dr.d) AS first_d
           FROM draws dr JOIN cumw c ON dr.x >= c.lo AND dr.x < c.hi GROUP BY 1, 2, 3),
ranked AS (SELECT order_id, product_id, size, row_number() OVER (PARTITION BY order_id ORDER BY first_d) AS pick
           FROM picked)
"""


@register("weighted_sample_distinct", ",\n" + SAMPLE_SQL + """
SELECT order_id, product_id, pick FROM ranked WHERE pick <= size""")
def q_weighted_sample_distinct(t):
    sized = G.fixed_mix_shuffle(t.orders.select("order_id"), "order_id", SEED)
    return G.weighted_sample_distinct(sized, _menu(t), SEED)
