"""Distributed numbering, running totals and top-k.

``number_within`` replaces ``row_number() OVER (PARTITION BY g ORDER BY o)``
where one group may hold a large share of all rows, ``running_sum`` replaces
a running total over a whole frame. Both cut the order into bins of nearly
equal numbers of rows. The cut points are quantiles of the rows' order keys,
read off a sample of the rows whose key hashes lowest (a sketch that merges by
union and repeats exactly); they enter the plan once, as one literal, so a
row's bin is a column expression of that row: nothing depends on partition
ids or on which attempt of a task ran. Any cut points give right results,
their quality decides the balance alone. A window numbers (or sums) the rows
of one bin, and the bins before it add their counts (or totals), a table with
one row per bin and group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BIN = 50_000
MAX_BINS = 4096            # beyond ROWS_PER_BIN * MAX_BINS rows the bins grow
SAMPLE_PER_BIN = 128
HASHES = 1 << 40


def _unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    free = (f"_w{i}" for i in range(n + len(taken)))
    return [c for c in free if c not in taken][:n]


def _cut_points(df: DataFrame, order: list[str], rows_per_bin: int) -> tuple[Column, int]:
    """(array of the bins' first keys but the lowest, number of bins)."""
    kind = T.ArrayType(T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(order)]))
    keys = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    n = keys.count()
    bins = min(MAX_BINS, max(1, -(-n // rows_per_bin)))
    if bins == 1:
        return F.array().cast(kind), 1
    share = min(1.0, SAMPLE_PER_BIN * bins / n)
    low = F.pmod(F.xxhash64("k"), F.lit(HASHES)) < int(share * HASHES)
    # about SAMPLE_PER_BIN * MAX_BINS rows at most, whatever the input
    sample = keys.where(low).withColumn("i", F.row_number().over(Window.orderBy("k")))
    total = sample.count()
    at = sorted({total * j // bins + 1 for j in range(1, bins)})
    cuts = sample.where(F.col("i").isin(at)).agg(F.to_json(F.array_sort(F.collect_list("k")))).first()[0]
    return F.from_json(F.lit(cuts), kind), bins


def _with_bin(df: DataFrame, order: list[str], bin_: str, rows_per_bin: int) -> DataFrame | None:
    """``df`` with the number of its bin in ``order``: the cut points at or before the row's key, by binary search.

    None when all rows are one bin: there is nothing to add then, and no join.
    """
    cuts, bins = _cut_points(df, order, rows_per_bin)
    if bins == 1:
        return None
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bins.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= key, at + step).otherwise(at))
    return df.withColumn(bin_, found)


def number_within(df: DataFrame, group: list[str], order: list[str], name: str = "pos",
                  rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """1-based position of each row inside its group, by ``order``.

    ``order`` must make rows unique inside a group (ties would have no
    defined position). ``group`` may be empty: one global numbering. A null
    is a group of its own.
    """
    bin_, count, first, other, *copies = _unused(df, 4 + len(group))
    kept = [c for c in df.columns if c != name]
    binned = _with_bin(df, order, bin_, rows_per_bin)
    if binned is None:
        return df.select(*kept, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long").alias(name))
    local = F.row_number().over(Window.partitionBy(*group, bin_).orderBy(*order))
    before = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    sizes = binned.groupBy(*group, bin_).agg(F.count(F.lit(1)).alias(count))
    offsets = sizes.select(*[F.col(g).alias(c) for g, c in zip(group, copies)], F.col(bin_).alias(other),
                           F.coalesce(F.sum(count).over(before), F.lit(0)).alias(first))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(c)) for g, c in zip(group, copies)], F.col(bin_) == F.col(other))
    numbered = binned.withColumn(count, local).join(offsets, same)
    return numbered.select(*kept, (F.col(first) + F.col(count)).alias(name))


def top_k_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group. The ``rank <= k`` filter sits right on the
    window, so Spark inserts a WindowGroupLimit before the shuffle: each task
    sends at most k rows per group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def running_sum(df: DataFrame, order: list[str], value, name, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Inclusive running totals of ``value`` in ``order`` over the whole frame.

    ``value``/``name`` are one column name each, or equal-length lists. A null
    value counts as 0. ``order`` must make the rows unique.
    """
    values = [value] if isinstance(value, str) else list(value)
    names = [name] if isinstance(name, str) else list(name)
    bin_, other, *spare = _unused(df, 2 + 3 * len(values))
    total, offset, sums = (spare[i::3] for i in range(3))
    kept = [c for c in df.columns if c not in names]
    binned = _with_bin(df, order, bin_, rows_per_bin)
    if binned is None:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(*kept, *[F.sum(F.coalesce(F.col(v), F.lit(0))).over(whole).cast("long").alias(c) for v, c in zip(values, names)])
    inside = Window.partitionBy(bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(other).rowsBetween(Window.unboundedPreceding, -1)    # one row per bin
    totals = binned.groupBy(F.col(bin_).alias(other)).agg(*[F.sum(F.coalesce(F.col(v), F.lit(0))).alias(t) for v, t in zip(values, total)])
    offsets = totals.select(other, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o) for t, o in zip(total, offset)])
    local = binned.withColumns({s: F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside) for v, s in zip(values, sums)})
    out = local.join(offsets, F.col(bin_) == F.col(other))
    return out.select(*kept, *[(F.col(o) + F.col(s)).cast("long").alias(c) for o, s, c in zip(offset, sums, names)])
