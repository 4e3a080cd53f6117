"""Readers and catalog probes: table scans, catalog profile, exports, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Read-only Parquet scan; with ``schema`` the files are read with it
    (no inference), with ``columns`` only those are read."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    return df.select(*columns) if columns else df


def schema_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(section='schema:<table>', position, value='<column> <type>') from the schemas.

    The schema is metadata held by the driver (a few rows per table)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(f"schema:{name}", i + 1, f"{f.name} {f.dataType.simpleString()}")
            for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "section string, position long, value string")


def catalog_profile(tables: dict[str, DataFrame], orders: DataFrame, products: DataFrame,
                    ingredients: DataFrame) -> DataFrame:
    """What a question planner needs to know: schemas, the order date range,
    the menu (by product id) and the ingredients with their units (by name).

    Rows (section, position, value). Menu positions are the product ids;
    ingredient positions are their rank by name (distributed numbering).
    """
    from ledgerline.operators.partitioning import number_within

    dates = orders.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi")).select(
        F.lit("dates").alias("section"), F.lit(1).cast("long").alias("position"),
        F.concat(F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string")).alias("value"))
    menu = products.select(F.lit("menu").alias("section"), F.col("product_id").cast("long").alias("position"),
                           F.concat_ws(" | ", F.col("name"), F.col("category")).alias("value"))
    ing = number_within(ingredients.select("ingredient_id", "name", "unit"), [], ["name", "ingredient_id"], "pos")
    ing = ing.select(F.lit("ingredients").alias("section"), F.col("pos").cast("long").alias("position"),
                     F.concat(F.col("name"), F.lit(" ("), F.col("unit"), F.lit(")")).alias("value"))
    return reduce(DataFrame.unionByName, [schema_rows(tables), dates, menu, ing])


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read back a JSON report (one document, possibly pretty-printed)."""
    return spark.read.option("multiLine", True).json(path)


def read_csv_export(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV export with a header line; a UTF-8 byte-order mark on the first
    header is dropped by the reader. The schema is given, never inferred."""
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)


def metadata_gate(meta: DataFrame, key: str, wanted: str, key_col: str = "key", value_col: str = "value") -> None:
    """Refuse to go on unless ``meta`` maps ``key`` to ``wanted`` (one-row probe)."""
    hit = meta.where((F.col(key_col) == key) & (F.col(value_col) == wanted)).limit(1).collect()
    if not hit:
        raise RuntimeError(f"metadata {key!r} is not {wanted!r}; nothing changed")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns
