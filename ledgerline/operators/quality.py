"""Data-quality checks. Each returns rows ``(check, violations)``.

Every check is one aggregate over a scan or one anti/semi join: partial
aggregation runs before any shuffle, so a check costs about one pass over
its table. A publish (``rewrite.publish_validated``) needs all zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import as_date
from ledgerline.functions.text import fold_ascii


def _row(check: str, violations: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations")]


def run_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """COUNT(*) of each table, as rows ``(table_name, row_count)``."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def check_row_count(tables: dict[str, DataFrame], expected: dict[str, DataFrame | int]) -> DataFrame:
    """|actual - expected| rows per table; ``expected`` is an int or a frame to count."""
    parts = []
    for name, df in tables.items():
        exp = expected[name]
        n_exp = F.lit(exp) if isinstance(exp, int) else exp.select(F.count(F.lit(1))).scalar()
        parts.append(df.agg(*_row(f"row_count:{name}", F.abs(F.count(F.lit(1)) - n_exp))))
    return run_checks(parts)


def check_date_bounds(df: DataFrame, col: str, start, end) -> DataFrame:
    """MIN and MAX of ``col`` must equal the wanted bounds (0, 1 or 2 violations)."""
    lo, hi = F.min(col), F.max(col)
    bad = (F.when(lo.isNull() | (lo != as_date(start)), 1).otherwise(0)
           + F.when(hi.isNull() | (hi != as_date(end)), 1).otherwise(0))
    return df.agg(*_row("date_bounds", bad))


def date_gaps(df: DataFrame, col: str, start, end) -> DataFrame:
    """Days of ``[start, end]`` on which ``col`` has no row."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(end))).alias("day"))
    days = df.select(F.col(col).cast("date").alias("day")).distinct()
    return spine.join(days, "day", "left_anti")


def check_date_coverage(df: DataFrame, col: str, start, end) -> DataFrame:
    """Distinct days must equal the days in range: count of missing days."""
    return date_gaps(df, col, start, end).agg(*_row("date_coverage", F.count(F.lit(1))))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key has no parent (``PRAGMA foreign_key_check``)."""
    parent_key = parent_key or child_key
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(p, child_key, "left_anti")


def check_foreign_keys(pairs: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """One row per (name, child, parent, key): number of orphan child rows."""
    return run_checks([orphans(c, p, k).agg(*_row(f"foreign_key:{name}", F.count(F.lit(1))))
                       for name, c, p, k in pairs])


def check_unique(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """Surplus rows over unique keys: SUM(count - 1) over repeated keys."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.agg(*_row(f"unique:{name}", F.sum(F.col("n") - 1)))


def check_not_null(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """NULLs in NOT NULL columns (one row per column, from one scan)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'not_null:{name}.{c}', `{c}`" for c in cols)
    return counts.select(F.expr(f"stack({len(cols)}, {stack}) as (check, violations)")) \
        .select("check", F.col("violations").cast("bigint").alias("violations"))


def check_positive(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Values that are not > 0 (price, quantity, recipe quantity)."""
    counts = df.agg(*[F.count_if(F.col(c) <= 0).alias(c) for c in cols])
    stack = ", ".join(f"'positive:{name}.{c}', `{c}`" for c in cols)
    return counts.select(F.expr(f"stack({len(cols)}, {stack}) as (check, violations)")) \
        .select("check", F.col("violations").cast("bigint").alias("violations"))


def check_recipe_coverage(products: DataFrame, recipe_items: DataFrame) -> DataFrame:
    """Products without any recipe line."""
    return orphans(products.select("product_id"), recipe_items, "product_id") \
        .agg(*_row("recipe_coverage", F.count(F.lit(1))))


def check_margin(margin_rows: DataFrame) -> DataFrame:
    """Products whose recipe cost is not below the price (rows of ``margin_check``)."""
    return margin_rows.agg(*_row("margin", F.count(F.lit(1))))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Symmetric difference of two one-column sets, with the side it is on."""
    col = a.columns[0]
    b = b.select(F.col(b.columns[0]).alias(col))
    only_a = a.select(col).subtract(b).select(col, F.lit("left_only").alias("side"))
    only_b = b.subtract(a.select(col)).select(col, F.lit("right_only").alias("side"))
    return only_a.unionByName(only_b)


def check_catalog_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Name sets must be equal: size of the symmetric difference."""
    return set_difference(a, b).agg(*_row("catalog_equal", F.count(F.lit(1))))


def before_after_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(table_name, before, after) row counts of a rewrite."""
    b = count_rows(before).withColumnRenamed("row_count", "rows_before")
    a = count_rows(after).withColumnRenamed("row_count", "rows_after")
    return b.join(a, "table_name", "full")


def check_counts_kept(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    ba = before_after_counts(before, after)
    bad = F.count_if(~F.coalesce(F.col("rows_before") == F.col("rows_after"), F.lit(False)))
    return ba.agg(*_row("counts_kept", bad))


def check_nocase_lookup(products: DataFrame, name: str) -> DataFrame:
    """Exactly one product must match ``name`` ignoring ASCII case: |matches - 1|."""
    m = products.where(fold_ascii(F.col("name")) == fold_ascii(F.lit(name)))
    return m.agg(*_row("nocase_lookup", F.abs(F.count(F.lit(1)) - 1)))


def check_additive(parts: DataFrame, total: DataFrame, measures: list[str]) -> DataFrame:
    """Rows of ``parts`` must sum to the one-row ``total``: measures that differ."""
    sums = parts.agg(*[F.sum(m).alias(m) for m in measures])
    # the totals enter as scalar subqueries (one row each), not as a join
    bad = reduce(lambda x, y: x + y,
                 [F.when(F.col(m).eqNullSafe(total.select(m).scalar()), 0).otherwise(1) for m in measures])
    return sums.select(*_row("additive", bad))
