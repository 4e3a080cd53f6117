"""Table rewrites, versioned publishing and exports.

Tables are immutable inputs; a rewrite returns new DataFrames, and
``publish_validated`` writes them as a new version folder that becomes
visible only after the checks pass on the re-read data. Earlier versions
stay readable (the reference keeps a backup copy; a version folder is the
distributed equivalent of build-into-staging-then-rename).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.text import fold_ascii
from ledgerline.sources.roles import Tables

PUBLISHED_MARK, CLAIM_MARK = "_PUBLISHED", "_CLAIMED"


# ---- column and value rewrites ------------------------------------------------

def add_column_default(df: DataFrame, name: str, default=0, dtype: str = "bigint") -> DataFrame:
    """Add a NOT NULL column with a default when it is missing; else unchanged."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))


def update_from_map(df: DataFrame, mapping: DataFrame, key: str, value: str,
                    map_key: str = "name", map_value: str = "value", nocase: bool = True) -> DataFrame:
    """Set ``value`` from a (key -> new value) mapping, matching keys ignoring ASCII case.

    Rows whose key is not in the mapping keep their value. The mapping is
    first reduced to one value per folded key (the largest, so the result is
    deterministic), so the left join can never duplicate a row. The join is
    left to AQE: broadcast when the mapping is measured small, shuffle otherwise.
    """
    fold = fold_ascii if nocase else (lambda c: c)
    m = (mapping.select(fold(F.col(map_key)).alias("_k"), F.col(map_value).alias("_v"))
         .groupBy("_k").agg(F.max("_v").alias("_v")))
    j = df.withColumn("_k", fold(F.col(key))).join(m, "_k", "left")
    return j.select(*[F.coalesce(F.col("_v").cast(df.schema[value].dataType), F.col(value)).alias(value)
                      if c == value else F.col(c) for c in df.columns])


def map_rows(df: DataFrame, column: str, key: str = "name", value: str = "value") -> DataFrame:
    """One row (key, value) for each entry of the map ``column``; a null or empty map has none."""
    return df.select(F.explode(column).alias(key, value))


def update_from_maps(df: DataFrame, lists: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """``update_from_map`` with price lists that come as a map column, one list per row."""
    return update_from_map(df, map_rows(lists, column), key, value)


def update_correlated(items: DataFrame, products: DataFrame, key: str = "product_id",
                      target: str = "unit_price_cents", source: str = "price_cents") -> DataFrame:
    """Line value := value of its product (a correlated scalar lookup as a left join).

    A line without a product gets NULL; ``check_not_null`` then refuses it.
    """
    p = products.select(F.col(key), F.col(source).alias("_new"))
    j = items.join(p, key, "left")
    return j.select(*[F.col("_new").alias(target) if c == target else F.col(c) for c in items.columns])


def category_price_map(t: Tables) -> DataFrame:
    """Test binding for a price list: every distinct product name, upper-cased,
    priced 500.00 plus 1.00 per character of the name."""
    return (t.products.select(F.upper("name").alias("name")).distinct()
            .select("name", (50000 + 100 * F.length("name")).cast("bigint").alias("value")))


def reprice(t: Tables, price_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New menu prices by name, then every line's unit price from its product."""
    products = update_from_map(t.products, price_map, "name", "price_cents")
    items = update_correlated(t.order_items, products)
    return products, items


def upsert_by_key(old: DataFrame, batch: DataFrame, key: str, order_col: str | list[str] | None = None) -> DataFrame:
    """Insert or replace by ``key``; keys absent from the batch stay unchanged.

    Within the batch the row with the largest ``order_col`` (one column or
    several) wins for a key (the last one written); without one, the row whose
    other columns are largest, so a key never stays twice. The de-duplication is an aggregate (``max_by``)
    with partial aggregation before the shuffle, so a key repeated a huge
    number of times does not land whole in one task.
    """
    cols = old.columns
    order = [order_col] if isinstance(order_col, str) else list(order_col or [c for c in cols if c != key])
    rec = F.struct(*[F.col(c) for c in cols if c != key])
    batch = batch.groupBy(key).agg(F.max_by(rec, F.struct(*order)).alias("_r")).select(key, "_r.*")
    batch = batch.select(*cols)
    kept = old.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch)


# ---- sinks ----------------------------------------------------------------------

def export_csv(df: DataFrame, path: str, order_by: list[str] | None = None, mode: str = "overwrite") -> str:
    """CSV with a header, rows in ``order_by`` order across the part files.

    ``orderBy`` range-partitions, so part files are in key order and each
    is sorted; no single task holds the whole table. No BOM is written.
    """
    out = df.orderBy(*order_by) if order_by else df
    out.write.mode(mode).option("header", True).csv(path)
    return path


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A (small) report frame as JSON lines."""
    df.write.mode(mode).json(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_versions(spark: SparkSession, base: str) -> list[int]:
    """Published version numbers under ``base`` (folders ``v=<n>`` with the mark)."""
    fs, p, jvm = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), PUBLISHED_MARK)):
                out.append(int(name[2:]))
    return sorted(out)


def latest_version_path(spark: SparkSession, base: str) -> str | None:
    vs = list_versions(spark, base)
    return f"{base.rstrip('/')}/v={vs[-1]}" if vs else None


def _claim(spark: SparkSession, base: str) -> str:
    """Take the next version number; its folder."""
    fs, p, jvm = _fs(spark, base)
    existing = []
    if fs.exists(p):
        existing = [int(st.getPath().getName()[2:]) for st in fs.listStatus(p)
                    if st.getPath().getName().startswith("v=") and st.getPath().getName()[2:].isdigit()]
    n = (max(existing) + 1) if existing else 1
    target = f"{base.rstrip('/')}/v={n}"
    # the number is taken once: of two writers that chose it, the second fails here
    fs.create(jvm.org.apache.hadoop.fs.Path(target, CLAIM_MARK), False).close()
    return target


def _publish(spark: SparkSession, target: str, found: list[tuple[str, int]]) -> str:
    """Mark the version published, unless a check found violations."""
    failed = [(check, n) for check, n in found if n != 0]
    if failed:
        raise RuntimeError("checks failed; previous version kept: " + ", ".join(f"{check}={n}" for check, n in failed))
    fs, p, jvm = _fs(spark, target)
    fs.create(jvm.org.apache.hadoop.fs.Path(p, PUBLISHED_MARK), False).close()
    return target


def publish_observed(tables: dict[str, DataFrame], base: str, rules: dict[str, list],
                     partition_by: dict[str, list[str]] | None = None) -> str:
    """``publish_validated`` with the checks taken while the tables are written (``observed.write_observed``)."""
    from ledgerline.operators.observed import write_observed

    spark = next(iter(tables.values())).sparkSession
    target = _claim(spark, base)
    return _publish(spark, target, write_observed(tables, target, rules, partition_by))


def publish_validated(tables: dict[str, DataFrame], base: str,
                      checks: Callable[[dict[str, DataFrame]], DataFrame],
                      partition_by: dict[str, list[str]] | None = None) -> str:
    """Write ``tables`` as a new version, check the re-read copy, then publish.

    The new folder ``base/v=<n>`` is marked published only when every row of
    ``checks(reread_tables)`` has ``violations == 0``; otherwise a
    ``RuntimeError`` is raised and readers keep seeing the previous version
    (``latest_version_path``). Nothing is deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    target = _claim(spark, base)
    for name, df in tables.items():
        w = df.write.mode("errorifexists")
        if partition_by and name in partition_by:
            w = w.partitionBy(*partition_by[name])
        w.parquet(f"{target}/{name}")
    reread = {name: spark.read.parquet(f"{target}/{name}") for name in tables}
    failed = checks(reread).where(F.col("violations") != 0).collect()
    return _publish(spark, target, [(r["check"], r["violations"]) for r in failed])
