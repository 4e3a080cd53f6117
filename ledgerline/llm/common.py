"""Helpers shared by the operators: words, row keys, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import checkpoint_dir

# ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = "[ \\t-\\r]+"

# A frame of fixed-width rows is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 1_000_000
EXPAND_STEP = 100_000


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank text has none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WHITE_CLASS))


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.size(words(text)).cast("long")


def row_key(columns: list[Column]) -> tuple[Column, Column]:
    """128-bit identity of a row's values as two longs; a null differs from every value."""
    marks = F.concat_ws("", *[F.when(c.isNull(), "0").otherwise("1") for c in columns])
    return F.xxhash64(*columns, marks), F.xxhash64(F.lit("row"), marks, *columns)


def content_key(text: Column) -> tuple[Column, Column]:
    """128-bit identity of a text as two longs (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit("text"), t, F.length(t))


def fresh(df: DataFrame, prefix: str, n: int) -> list[str]:
    """``n`` column names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out, i = [], 0
    while len(out) < n:
        name = f"{prefix}{i}"
        if name.lower() not in taken:
            out.append(name)
        i += 1
    return out


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder.

    Unlike ``checkpoint`` the table is columnar and compressed, so later
    readers prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a *materialised* frame of fixed-width rows when it has at most
    ``rows`` rows; otherwise unchanged (the join shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def expand(df: DataFrame, count: str, index: str) -> DataFrame:
    """``count`` copies of each row, numbered 0.. in ``index``.

    Two generators of at most EXPAND_STEP elements each step, so that a row
    repeated billions of times never builds one array.
    """
    block, = fresh(df, "_block", 1)
    step = F.lit(EXPAND_STEP).cast("long")
    hi = F.col(count).cast("long")
    outer = df.where(hi > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((hi - 1) / step))))
    first = F.col(block) * step
    return outer.withColumn(index, F.explode(F.sequence(first, F.least(first + step, hi) - 1))).drop(block)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _holds_map(kind.elementType))


def has_maps(df: DataFrame) -> bool:
    return any(_holds_map(f.dataType) for f in df.schema.fields)


def row_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in a form that can be hashed: a column that holds a map as its JSON text, entries as stored."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]


def collapse_repeats(df: DataFrame, count: str) -> DataFrame:
    """Distinct rows with their number of repeats in ``count``.

    Repeated rows are interchangeable, so later steps may number the copies
    freely. A first pass over 16-byte row keys finds the keys that repeat;
    only rows of these are grouped (with map-side combining), all others pass
    through, without a shuffle while the repeated keys are few enough for a
    broadcast.
    """
    a, b, row = fresh(df, "_r", 3)
    ka, kb = row_key(row_columns(df))
    keyed = df.withColumns({a: ka, b: kb})
    repeated = stored(keyed.select(a, b).groupBy(a, b).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1))
    if not repeated.limit(1).collect():
        return df.withColumn(count, F.lit(1).cast("long"))
    few = bounded(repeated)
    single = keyed.join(few.select(a, b), [a, b], "left_anti").drop(a, b).withColumn(count, F.lit(1).cast("long"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    many = keyed.join(few, [a, b]).groupBy(a, b).agg(F.first(whole).alias(row), F.first(count).alias(count))
    return single.unionByName(many.select(f"{row}.*", count))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
