"""Seeded draws over tables: weighted choice, exact mixes, distinct weighted samples.

Randomness is a seeded hash: ``uniform32(seed, key)`` takes the first 8 hex
digits of ``md5(seed|key)`` -- a value in 0..2^32-1 that any engine can
repeat. A weighted choice compares ``u * W`` with ``C_i * 2^32`` in integer
arithmetic (``C_i`` cumulative integer weights, ``W`` their total), so no
floating-point boundary can differ between runs or engines.

Drawing from a weighted table: every row covers the interval [lo, hi) of its
cumulative weight, and a draw ``x = u * W div 2^32`` takes the row whose
interval holds it. A table of bounded size is broadcast and searched; a larger
one is an equi-join: the axis 0..W-1 is cut into equal cells, a row stands in
the cells that its interval touches (rows + cells in all, whatever the
weights), and a draw looks up its cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.functions.calendar import as_date
from ledgerline.session import checkpoint_dir
from ledgerline.operators.partitioning import number_within, running_sum

TWO32 = 1 << 32
MAX_WEIGHT = 1 << 31
# Products (two numbers each) whose cumulative weights are broadcast at most.
BROADCAST_ROWS = 1_000_000
# Draws ahead per missing product in one round, at most.
MAX_AHEAD = 1024
# Fixed values of the sales laws (weights and size mix).
BRANCHES = (("Suwaiq", 60), ("Farid", 40))
PAYMENTS = (("Cash", 35), ("Card", 65))
ORDER_SIZES = ((1, 2), (2, 1), (3, 2))          # 1400 : 700 : 1400


def uniform32(seed, key: Column) -> Column:
    """Seeded uniform integer in 0..2^32-1 from md5(seed|key)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def weighted_choice(u: Column, choices: tuple) -> Column:
    """Pick a value from ``((value, integer weight), ...)`` with uniform ``u``."""
    total = sum(w for _, w in choices)
    expr = None
    cum = 0
    for value, w in choices:
        cum += w
        cond = u * total < F.lit(cum * TWO32)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """Every day from ``start`` to ``end`` (inclusive), column ``day``."""
    return spark.range(1).select(F.explode(F.sequence(as_date(start), as_date(end))).alias("day"))


def weight_cells(table: DataFrame, weight: Column, key: str) -> tuple[DataFrame, int, int]:
    """((cell, lo, hi, key) rows, total weight, cell width) of a weighted table.

    Cumulative bounds are a distributed running sum (``running_sum``), so a
    large weighted table is never gathered into one task.
    """
    checkpoint_dir(table.sparkSession)
    # read by every step of the running sum
    t = table.select(key, weight.cast("bigint").alias("_w")).where(F.col("_w") > 0).checkpoint()
    cum = running_sum(t, [key], "_w", "hi").select(key, (F.col("hi") - F.col("_w")).alias("lo"), "hi")
    n, total = cum.agg(F.count(F.lit(1)), F.coalesce(F.max("hi"), F.lit(0))).first()
    if total >= MAX_WEIGHT:
        raise ValueError("total weight must be below 2^31 (scale the weights down)")
    width = max(1, total // max(1, n))
    cells = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # read by every round of draws
    return cells.select("cell", "lo", "hi", key).checkpoint(), total, width


def fixed_mix(n_col: Column, n_total: int, mix: tuple = ORDER_SIZES) -> Column:
    """Value by rank band: exact counts in proportion to the mix weights
    (the last band takes the rest)."""
    total = sum(w for _, w in mix)
    expr = None
    upto = 0
    for i, (value, w) in enumerate(mix):
        upto = n_total if i == len(mix) - 1 else upto + (n_total * w) // total
        cond = n_col <= upto
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def fixed_mix_shuffle(df: DataFrame, key: str, seed, mix: tuple = ORDER_SIZES, name: str = "size") -> DataFrame:
    """Give every row a value so that the counts follow ``mix`` exactly and
    the assignment is a seeded shuffle (rank by hash, then bands of ranks)."""
    n = df.count()
    h = df.withColumn("_h", uniform32(seed, F.col(key)))
    ranked = number_within(h, [], ["_h", key], "_rank")
    return ranked.withColumn(name, fixed_mix(F.col("_rank"), n, mix)).drop("_h", "_rank")


def _drawn_within(need: DataFrame, table: list, seed, key: str, product_key: str, kind: str) -> DataFrame:
    """The draws of every order made where its row is, one lookup each in the broadcast cumulative weights."""
    ids, ends = np.array([r[0] for r in table], object), np.cumsum([r[1] for r in table])
    if len(ends) and ends[-1] >= MAX_WEIGHT:
        raise ValueError("total weight must be below 2^31 (scale the weights down)")
    shared = need.sparkSession.sparkContext.broadcast((ids, ends))
    id_type = to_arrow_type(need.sparkSession.createDataFrame([], f"x {kind}").schema[0].dataType)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends = shared.value
        for batch in batches:
            rows, places, picks = [], [], []
            for i, (order, text, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                seen, d = set(), 0
                while len(seen) < (size or 0):
                    u = int(hashlib.md5(f"{seed}|{text}|{d}".encode()).hexdigest()[:8], 16)
                    at = int(np.searchsorted(ends, u * int(ends[-1]) >> 32, side="right"))
                    d += 1
                    if at not in seen:
                        seen.add(at)
                        rows.append(i)
                        places.append(at)
                        picks.append(len(seen))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids[places].tolist(), id_type),
                                              pa.array(picks, pa.int32())], names=[key, product_key, "pick"])
    row = need.select(key, F.col(key).cast("string").alias("_text"), "_size")
    return row.mapInArrow(draw, f"`{key}` {need.schema[key].dataType.simpleString()}, `{product_key}` {kind}, pick int")


def weighted_sample_distinct(orders: DataFrame, products: DataFrame, seed, size_col: str = "size",
                             key: str = "order_id", product_key: str = "product_id",
                             weight_col: str = "weight", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(order_id, product_id, pick) with ``size`` distinct products per order,
    drawn by weight with repeats redrawn.

    The draws of an order form one seeded i.i.d. sequence; the result is its
    first ``size`` distinct values, which is exactly "draw, redraw repeats".
    With at most ``broadcast_rows`` products their cumulative weights are
    broadcast and an order draws until it has its products, in the task that
    holds its row: no shuffle, no rounds. A larger table of products is cut
    into cells and joined in rounds (``_drawn_in_rounds``), with the same
    result. An order that wants more products than have a weight is refused
    before the first draw.
    """
    need = orders.select(key, F.col(size_col).cast("int").alias("_size"))
    weight = F.col(weight_col).cast("bigint")
    drawn = products.where(weight > 0).select(product_key, weight.alias("_w"))
    if drawn.count() > broadcast_rows:
        return _drawn_in_rounds(need, products, seed, key, product_key, weight_col)
    # nothing but the bounded table of products is gathered
    table = drawn.orderBy(product_key).collect()
    need = need.checkpoint()    # read twice
    largest = need.agg(F.max("_size")).first()[0] or 0
    if largest > len(table):
        raise ValueError(f"an order wants {largest} distinct products, {len(table)} have a weight")
    return _drawn_within(need, table, seed, key, product_key, products.schema[product_key].dataType.simpleString())


def _drawn_in_rounds(need: DataFrame, products: DataFrame, seed, key: str, product_key: str, weight_col: str) -> DataFrame:
    """The same draws by joins with cells of the weight axis.

    The sequence is consumed in rounds. The first makes as many draws as an
    order wants products: in a large table few repeat, so nearly all orders
    are done. Only orders still short go on, with their picks and further
    ahead every round: the first ``size`` products in draw order are the same
    as if drawn one at a time. A round shuffles its draws twice, by cell and
    by order, and is cut from its lineage with ``checkpoint``. Per-order
    windows hold at most the draws of one order in one round. Rows that share
    a key share its draws.
    """
    cells, total, width = weight_cells(products.select(product_key, weight_col), F.col(weight_col), product_key)
    # the input is read once: its lineage (shuffles, numbering) is cut here
    asked = need.groupBy(key).agg(F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_rows")).checkpoint()
    largest, rows = asked.agg(F.max("_size"), F.max("_rows")).first()
    drawable = cells.select(product_key).distinct().count()
    if (largest or 0) > drawable:
        raise ValueError(f"an order wants {largest} distinct products, {drawable} have a weight")
    short = asked.where("_size > 0").select(key, "_size", F.lit(0).alias("_have"), F.lit(0).cast("bigint").alias("_used"))
    held, done, r = None, [], 0
    while short.limit(1).count():
        ahead = 1 if r == 0 else min(4 << r, MAX_AHEAD)
        r += 1
        stop = F.col("_used") + (F.col("_size") - F.col("_have")) * ahead
        draws = short.select(key, "_size", stop.alias("_next"), F.explode(F.sequence(F.col("_used"), stop - 1)).alias("_d"))
        u = uniform32(seed, F.concat(F.coalesce(F.col(key).cast("string"), F.lit("None")), F.lit("|"), F.col("_d").cast("string")))
        x = draws.withColumn("x", F.shiftright(u * total, 32))
        picked = (x.withColumn("cell", F.floor(F.col("x") / width)).join(cells, "cell")
                  .where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select(key, "_size", "_next", "_d", product_key))
        if held is not None:
            picked = picked.unionByName(held)
        # one shuffle by order serves the distinct products, their ranks and their number
        first = picked.repartition(key).groupBy(key, product_key).agg(
            F.min("_d").alias("_d"), F.max("_size").alias("_size"), F.max("_next").alias("_next"))
        ranked = first.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy("_d"))).where("pick <= _size")
        ranked = ranked.withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy(key)).cast("int")).checkpoint()
        done.append(ranked.where("_have = _size").select(key, product_key, "pick"))
        open_ = ranked.where("_have < _size")
        held = open_.select(key, "_size", "_next", "_d", product_key)
        short = open_.groupBy(key).agg(F.max("_size").alias("_size"), F.max("_have").alias("_have"), F.max("_next").alias("_used"))
    if not done:
        kind = products.schema[product_key].dataType
        return need.where(F.lit(False)).select(key, F.lit(None).cast(kind).alias(product_key), F.lit(0).alias("pick"))
    out = reduce(DataFrame.unionByName, done)
    if rows == 1:
        return out
    wanted = need.where("_size > 0").select(F.col(key).alias("_key"), "_size")
    return wanted.join(out, F.col("_key").eqNullSafe(F.col(key)) & (F.col("pick") <= F.col("_size"))).select(key, product_key, "pick")
