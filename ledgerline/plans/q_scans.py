"""Source queries: table scan, catalog profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.money import half_even, to_cents
from ledgerline.functions.text import file_stem, label_text, normalize_whitespace
from ledgerline.plans.registry import register
from ledgerline.sources import readers

PART_SCHEMA = ("p_partkey bigint, p_name string, p_brand string, p_type string, "
               "p_size int, p_retailprice double")


@register("scan_table", "SELECT p_partkey, p_name, p_type, p_retailprice FROM part", use_roles=False)
def q_scan_table(t):
    return readers.scan_table(t.spark, f"{t.base}/part.parquet", PART_SCHEMA,
                              ["p_partkey", "p_name", "p_type", "p_retailprice"])


@register("catalog_profile_data", """
SELECT 'dates' AS section, CAST(1 AS BIGINT) AS position,
       CAST(min(order_date) AS VARCHAR) || ' to ' || CAST(max(order_date) AS VARCHAR) AS value FROM s_orders
UNION ALL SELECT 'menu', product_id, name || ' | ' || category FROM products
UNION ALL SELECT 'ingredients', row_number() OVER (ORDER BY name, ingredient_id), name || ' (' || unit || ')'
FROM ingredients""")
def q_catalog_profile_data(t):
    prof = readers.catalog_profile(t.views(), t.orders, t.products, t.ingredients)
    return prof.where(~prof["section"].startswith("schema:"))


# The role tables' columns, as the profile has to list them.
ROLE_COLUMNS = {
    "ingredients": "ingredient_id bigint, name string, unit string, cost_per_unit_cents bigint",
    "order_items": "order_id bigint, product_id bigint, line_number int, quantity bigint, unit_price_cents bigint, "
                   "unit_cost_cents bigint",
    "orders": "order_id bigint, order_date date, branch string, payment_method string",
    "products": "product_id bigint, name string, category string, price_cents bigint",
    "recipe_items": "recipe_item_id bigint, product_id bigint, ingredient_id bigint, quantity double",
}
_SCHEMA_SQL = ", ".join(f"('schema:{table}', {i}, '{column}')" for table, columns in ROLE_COLUMNS.items()
                        for i, column in enumerate(columns.split(", "), 1))


@register("catalog_profile", f"""
SELECT section, CAST(position AS BIGINT) AS position, value FROM (VALUES {_SCHEMA_SQL}) AS s(section, position, value)
UNION ALL SELECT 'dates' AS section, CAST(1 AS BIGINT) AS position,
       CAST(min(order_date) AS VARCHAR) || ' to ' || CAST(max(order_date) AS VARCHAR) AS value FROM s_orders
UNION ALL SELECT 'menu', product_id, name || ' | ' || category FROM products
UNION ALL SELECT 'ingredients', row_number() OVER (ORDER BY name, ingredient_id), name || ' (' || unit || ')'
FROM ingredients""")
def q_catalog_profile(t):
    return readers.catalog_profile(t.views(), t.orders, t.products, t.ingredients)


# ---- scalar functions (F1-F16), one query per group -----------------------------

@register("scalar_dates", """
SELECT order_id, strftime(order_date, '%Y') AS year_text, isodow(order_date) - 1 AS weekday,
       last_day(order_date) AS month_end, order_date + 1 AS next_day, order_date - 1 AS previous_day,
       CAST(date_trunc('month', order_date) AS DATE) AS month_start, strftime(order_date, '%Y-%m-%d') AS iso
FROM s_orders""")
def q_scalar_dates(t):
    d = F.col("order_date")
    return t.orders.select("order_id", F.date_format(d, "yyyy").alias("year_text"),
                           F.weekday(d).alias("weekday"), F.last_day(d).alias("month_end"),
                           F.date_add(d, 1).alias("next_day"), F.date_sub(d, 1).alias("previous_day"),
                           F.trunc(d, "MM").alias("month_start"), F.date_format(d, "yyyy-MM-dd").alias("iso"))


@register("scalar_format", """
SELECT product_id, format('{:,.2f}', CAST(price_cents AS DOUBLE) / 100) AS price_text,
       upper(substring(replace(name, ' ', '_'), 1, 1)) || lower(substring(replace(replace(name, ' ', '_'), '_', ' '), 2))
         AS label, upper(category) AS category_upper, concat_ws('; ', name, category) AS joined
FROM products""")
def q_scalar_format(t):
    p = t.products
    return p.select("product_id",
                    F.format_number(F.col("price_cents").cast("double") / 100, 2).alias("price_text"),
                    label_text(F.regexp_replace("name", " ", "_")).alias("label"),
                    F.upper("category").alias("category_upper"),
                    F.concat_ws("; ", "name", "category").alias("joined"))


@register("scalar_text", r"""
SELECT doc_id, length(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS normalized_chars,
       ends_with(trim(text), '.') AS ends_with_period,
       regexp_replace(source, '\.[^.]*$', '') || '_p1_c1' AS first_chunk_id,
       regexp_replace(source || '_cents', '_cents$', '_pkr') AS swapped
FROM documents""", use_roles=False)
def q_scalar_text(t):
    d = t.raw("documents")
    return d.select("doc_id", F.length(normalize_whitespace(F.col("text"))).alias("normalized_chars"),
                    F.trim("text").endswith(".").alias("ends_with_period"),
                    F.concat(file_stem(F.col("source")), F.lit("_p1_c1")).alias("first_chunk_id"),
                    F.regexp_replace(F.concat("source", F.lit("_cents")), "_cents$", "_pkr").alias("swapped"))


@register("scalar_money", """
SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS extended_cents,
       CAST(round_even(l_extendedprice, 0) AS BIGINT) AS extended_half_even,
       COALESCE(CASE WHEN l_discount > 0.05 THEN l_discount END, 0) AS discount_or_zero,
       round(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100, 2) AS extended_pkr
FROM lineitem""", use_roles=False)
def q_scalar_money(t):
    li = t.raw("lineitem")
    cents = to_cents(F.col("l_extendedprice"))
    return li.select("l_orderkey", "l_linenumber", cents.alias("extended_cents"),
                     half_even(F.col("l_extendedprice")).cast("bigint").alias("extended_half_even"),
                     F.coalesce(F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.lit(0.0))
                     .alias("discount_or_zero"),
                     F.round(cents.cast("double") / 100, 2).alias("extended_pkr"))
