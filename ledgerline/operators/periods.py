"""Many calendar requests answered at once.

``period_join``      -- rows whose date lies inside each request's inclusive
                        period, as equi-joins: a period is a few aligned
                        dyadic blocks of days, a day stands in one block per
                        level.

``period_aggregate`` -- any aggregate that combines (maximum, minimum, sum)
                        over the days of each request's period, from block
                        aggregates: O(log days) rows per request.

``period_report``    -- summary measures per request. Measures are additive
                        over days, so the report needs no (request x order)
                        pairs at all: sales are reduced to one row per calendar
                        day, turned into running totals over a dense day spine,
                        and each request reads two running totals (end day and
                        the day before its start). Work is O(lines) for the daily
                        reduction plus O(requests) for two equi-joins against a
                        table whose size is the number of calendar days in the
                        data -- independent of data volume. ``orders_in_periods``
                        counts the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import sales
from ledgerline.session import checkpoint_dir
from ledgerline.sources.roles import Tables

REPORT_MEASURES = ("orders",) + sales.MEASURES
# Facts (or pairs of a period and a day) that a join may broadcast, in rows.
BROADCAST_ROWS = 200_000


# ---- dyadic blocks ------------------------------------------------------------------
#
# Block (level, at) holds the days at * 2^level .. (at + 1) * 2^level - 1, counted from a base day.

def levels_of(lo: date, hi: date) -> int:
    """Number of levels that cover the days lo..hi."""
    return (hi - lo).days.bit_length() + 1


def _blocks_between(first: Column, stop: Column, levels: int) -> Column:
    """Array of (level, at): the disjoint blocks of the days first..stop - 1, at most two per level.

    Level by level the period is cut to even bounds; an odd bound gives a block of that level.
    """
    blocks = []
    for level in range(levels):
        width = 1 << level
        s, e = F.floor((first + (width - 1)) / width).cast("int"), F.floor(stop / width).cast("int")
        odd = F.pmod(s, F.lit(2)) == 1
        for take, at in (((s < e) & odd, s), ((s + odd.cast("int") < e) & (F.pmod(e, F.lit(2)) == 1), e - 1)):
            blocks.append(F.when(take, F.struct(F.lit(level).alias("level"), at.alias("at"))))
    return F.filter(F.array(*blocks), lambda b: b.isNotNull())


def with_blocks(periods: DataFrame, start_col: str, end_col: str, lo: date, hi: date) -> DataFrame:
    """``periods`` with a row (_level, _at) for each block of start..end, clipped to lo..hi; none where a bound is null or end < start."""
    base, s, e = F.lit(lo).cast("date"), F.col(start_col), F.col(end_col)
    first = F.when(s.isNotNull(), F.greatest(F.datediff(s, base), F.lit(0))).alias("_first")
    stop = F.when(e.isNotNull(), F.least(F.datediff(e, base), F.lit((hi - lo).days)) + 1).alias("_stop")
    # through a generator, so that what the bounds were derived from is computed once, not copied into every level
    p = periods.select("*", F.inline(F.array(F.struct(first, stop)))).where("_first < _stop")
    p = p.select("*", F.inline(_blocks_between(F.col("_first"), F.col("_stop"), levels_of(lo, hi))).alias("_level", "_at"))
    return p.drop("_first", "_stop")


def day_blocks(day: Column, lo: date, hi: date) -> Column:
    """Array of (level, at): the block of each level that holds ``day``."""
    offset = F.datediff(day, F.lit(lo).cast("date"))
    return F.transform(F.sequence(F.lit(0), F.lit(levels_of(lo, hi) - 1)),
                       lambda level: F.struct(level.alias("level"), F.floor(offset / F.pow(F.lit(2.0), level)).cast("int").alias("at")))


def _bounds(facts: DataFrame, date_col: str) -> tuple[date, date] | None:
    lo, hi = facts.agg(F.min(date_col), F.max(date_col)).first()
    return None if lo is None else (lo, hi)


def period_join(periods: DataFrame, facts: DataFrame, date_col: str,
                start_col: str = "date_start", end_col: str = "date_end", salts: int = 1) -> DataFrame:
    """Inner range join: fact rows with ``start <= date <= end``.

    The periods' blocks meet the blocks of the days that occur in the facts:
    one equi-join, in which every pair is a (period, day) of the result, since
    a period's blocks are disjoint. The facts join on their day, as they are.
    A period with a NULL bound, or with end before start, matches nothing.
    ``salts`` splits each day: facts take one of so many salts, the (period,
    day) pairs are copied to all of them.

    A planner's estimate knows nothing of the rows that a period grows into,
    so the sides to broadcast are chosen by counts: the days that occur (by
    level) always, the facts up to BROADCAST_ROWS, the (period, day) pairs if
    there can't be more of them than that. Else facts and pairs are shuffled.
    """
    lo, hi, n_facts = facts.agg(F.min(date_col), F.max(date_col), F.count(date_col)).first()
    bounds = None if lo is None else (lo, hi)
    if bounds is None:
        return periods.withColumn("_none", F.lit(1)).join(facts.where("false").withColumn("_none", F.lit(1)), "_none").drop("_none")
    days = facts.where(F.col(date_col).isNotNull()).select(F.col(date_col).alias("_day")).distinct()
    days = days.select("_day", F.inline(day_blocks(F.col("_day"), *bounds)).alias("_level", "_at"))
    p = with_blocks(periods, start_col, end_col, *bounds)
    pairs = p.join(F.broadcast(days), ["_level", "_at"]).drop("_level", "_at")
    pairs = pairs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    f = facts.withColumns({"_day": F.col(date_col), "_salt": F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")})
    if n_facts <= BROADCAST_ROWS:
        f = F.broadcast(f)
    else:
        few = BROADCAST_ROWS // (((hi - lo).days + 1) * salts)
        if periods.limit(few + 1).count() > few:
            pairs = pairs.hint("shuffle_merge")
    return pairs.join(f, ["_day", "_salt"]).drop("_day", "_salt")


def period_aggregate(periods: DataFrame, daily: DataFrame, date_col: str, measures: dict[str, Callable[[str], Column]],
                     key: str = "request_id", start_col: str = "date_start", end_col: str = "date_end") -> DataFrame:
    """(key, measures) of every period with at least one row of ``daily`` inside.

    ``measures`` maps a column of ``daily`` to an aggregate that gives the
    same over parts as over the whole (``F.max``, ``F.min``, ``F.sum``). It is
    taken once per block, then over the blocks of each period: a period of
    years reads some twenty rows.
    """
    columns = list(measures)
    bounds = _bounds(daily, date_col)
    if bounds is None:
        return periods.select(key, F.lit(1).alias("_none")).join(daily.where("false").select(F.lit(1).alias("_none"), *columns), "_none").drop("_none")
    blocks = (daily.where(F.col(date_col).isNotNull()).select(F.inline(day_blocks(F.col(date_col), *bounds)).alias("_level", "_at"), *columns)
              .groupBy("_level", "_at").agg(*[f(c).alias(c) for c, f in measures.items()]))
    p = with_blocks(periods.select(key, start_col, end_col), start_col, end_col, *bounds)
    # at most one row per level and day that occurs; left to an estimate, the periods would be broadcast, of which there may be millions
    return p.join(F.broadcast(blocks), ["_level", "_at"]).groupBy(key).agg(*[f(c).alias(c) for c, f in measures.items()])


def busiest_days(t: Tables, periods: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, busiest_day, busiest_orders, quietest_orders): the day with the most orders (the first of equals) and the
    least number of orders on a day with any, per request with an order in its period."""
    daily = (t.orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
             .select("order_date", F.struct("n", (-F.unix_date("order_date")).alias("d")).alias("most"), F.col("n").alias("least")))
    found = period_aggregate(periods, daily, "order_date", {"most": F.max, "least": F.min}, key)
    return found.select(key, F.date_from_unix_date(-F.col("most.d")).alias("busiest_day"),
                        F.col("most.n").alias("busiest_orders"), F.col("least").alias("quietest_orders"))


# ---- running totals -------------------------------------------------------------------

def _running(daily: DataFrame, spine: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """(day, running totals) for every day of ``spine``; the table has one row per calendar day."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = spine.join(daily, "day", "left")
    return filled.select("day", *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(w).alias(m) for m in measures])


def _differences(periods: DataFrame, cum: DataFrame, measures: tuple[str, ...], start_col: str, end_col: str) -> DataFrame:
    """``periods`` with each measure's total inside the period, from two running totals (``_inside``: there is a day at all)."""
    lo, hi = (F.lit(x).cast("date") for x in cum.agg(F.min("day"), F.max("day")).first())
    s, e = F.col(start_col), F.col(end_col)
    both = s.isNotNull() & e.isNotNull()
    # through a generator, so that no filter on the keys is pushed into the columns that the period was derived from
    keys = F.struct(F.when(both, F.least(e, hi)).alias("_end_key"), F.when(both, F.greatest(F.date_sub(s, 1), lo)).alias("_before_key"))
    req = periods.select("*", F.inline(F.array(keys)))
    at_end = cum.select(F.col("day").alias("_end_key"), *[F.col(m).alias("_e_" + m) for m in measures])
    before = cum.select(F.col("day").alias("_before_key"), *[F.col(m).alias("_b_" + m) for m in measures])
    j = req.join(at_end, "_end_key", "left").join(before, "_before_key", "left")
    return j.select(*[F.col(c) for c in periods.columns], (F.col("_end_key") > F.col("_before_key")).alias("_inside"),
                    *[(F.col("_e_" + m) - F.col("_b_" + m)).alias("_d_" + m) for m in measures])


def orders_in_periods(t: Tables, periods: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, order_days, orders) of every request with at least one order in its period, from running totals of the days."""
    daily = t.orders.groupBy(F.col("order_date").alias("day")).agg(F.count(F.lit(1)).alias("orders"), F.lit(1).alias("order_days"))
    lo, hi = _spine_bounds(t)
    spine = t.spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("day"))
    checkpoint_dir(t.spark)
    counts = ("order_days", "orders")
    cum = _running(daily, spine, counts).checkpoint()
    found = _differences(periods.select(key, "date_start", "date_end"), cum, counts, "date_start", "date_end")
    return found.where(F.col("_inside") & (F.col("_d_orders") > 0)).select(key, *[F.col("_d_" + m).cast("bigint").alias(m) for m in counts])


def _spine_bounds(t: Tables):
    """(lo, hi) as scalar subqueries: the day before the first order date and
    the last order date (a scan of the orders' date column only)."""
    rng = sales.date_range(t)
    return (rng.select(F.date_sub("first_date", 1)).scalar(), rng.select("last_date").scalar())


def daily_running_totals(t: Tables) -> DataFrame:
    """(day, running totals of orders and measures) for every calendar day, materialised once.

    The spine runs from the day before the first order date to the last one,
    so every lookup inside the data range finds a row; the row before the
    first day holds zeros. The table has one row per calendar day (about
    2,600 for seven years, whatever the data volume), so one window task
    over it is the cheapest plan; a data-sized table would use
    ``partitioning.running_sum`` instead.
    """
    daily = sales.summary(t, "day")
    lo, hi = _spine_bounds(t)
    spine = t.spark.range(1).select(F.explode(F.sequence(lo, hi)).alias("day"))
    checkpoint_dir(t.spark)
    return _running(daily, spine, REPORT_MEASURES).checkpoint()


def period_report(t: Tables, periods: DataFrame, start_col: str = "date_start",
                  end_col: str = "date_end") -> DataFrame:
    """Every request row plus orders, units, revenue, cost and profit in its period.

    Requests with no period, an error, or no sales in the period are kept:
    orders 0, sums NULL (as SUM over no rows).
    """
    j = _differences(periods, daily_running_totals(t), REPORT_MEASURES, start_col, end_col)
    n_orders = F.coalesce(F.when(F.col("_inside"), F.col("_d_orders")), F.lit(0))
    return j.select(*[F.col(c) for c in periods.columns], n_orders.cast("bigint").alias("orders"),
                    *[F.when(n_orders > 0, F.col("_d_" + m)).cast("bigint").alias(m) for m in sales.MEASURES])
