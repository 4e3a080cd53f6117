"""Mixing sources to target weights by the cube method.

A source's target share fixes how often its documents are taken: ``rate`` =
target / size of the source, at most 3. The whole part of the rate is taken
for sure; the fractional part is an inclusion probability, and the cube
method turns those probabilities into 0/1 while it keeps the source's total
of words and number of documents balanced:

- flight: three open documents at a time move along the null space of the
  two constraints (words, documents) until one of them reaches 0 or 1;
- blocks of bounded size fly in parallel, each leaving at most two open
  documents; those are gathered into new blocks and fly again, until one
  block per source is left;
- landing: the last two documents give up the document balance, the last
  one is drawn.

Blocks are dealt by a hash of the row, so a hot source is many blocks; the
random numbers come from (seed, round, source, block), so reruns agree.
Only (key, size, probability) rows are moved; texts are joined afterwards.

Defined results: a null source is a source of its own (last in order); null
or blank texts have size 0; a source without words has target 0 and gives
nothing; an empty table gives no rows; repeated rows are separate documents.
Extra columns are kept by ``mixed`` and ignored by ``digest``.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, collapse_repeats, cut, expand, fresh, row_columns, row_key, stored, word_count

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK = 512
SEED = 8
EPS = 1e-9


def _step(i: list[int], u: list[float], p: list[float], rng: random.Random) -> None:
    """Move the units ``i`` along ``u`` or against it until one reaches 0 or 1; expectation unchanged."""
    ahead = back = float("inf")
    for k, d in zip(i, u):
        if d > 0:
            ahead, back = min(ahead, (1 - p[k]) / d), min(back, p[k] / d)
        elif d < 0:
            ahead, back = min(ahead, p[k] / -d), min(back, (1 - p[k]) / -d)
    t = ahead if rng.random() * (ahead + back) < back else -back
    for k, d in zip(i, u):
        x = p[k] + t * d
        p[k] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def flight(size: list[float], p: list[float], rng: random.Random, land: bool = False) -> list[float]:
    """Probabilities after the flight phase: at most two stay open, none with ``land``."""
    p = list(p)
    live: list[int] = []
    for k, x in enumerate(p):
        if not 0 < x < 1:
            continue
        live.append(k)
        if len(live) == 3:
            a, b, c = (size[j] for j in live)
            u = [b - c, c - a, a - b]
            _step(live, u if any(u) else [1.0, -1.0, 0.0], p, rng)
            live = [j for j in live if 0 < p[j] < 1]
    while land and live:
        if len(live) == 2:
            a, b = size[live[0]], size[live[1]]
            _step(live, [b, -a] if a or b else [1.0, -1.0], p, rng)
        else:
            p[live[0]] = float(rng.random() < p[live[0]])
        live = [j for j in live if 0 < p[j] < 1]
    return p


def targets(light: DataFrame) -> DataFrame:
    """One row per source: (source, sid, source_size, source_rows, target, rate).

    The capped shares are a water level: with the sources ordered by cap /
    weight, a source is capped while its cap lies below its share of what
    the earlier ones leave over. The windows run over the sources, one row each.
    """
    s = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    everything = Window.partitionBy()
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                                            (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", (MAX_REPEAT * F.col("source_size")).cast("double"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    s = s.withColumn("_all", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("_spent", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("_unit", (F.col("_all") - F.col("_spent")) / F.col("_open"))
    s = s.withColumn("_capped", F.col("cap") < F.col("weight") * F.col("_unit"))
    s = s.withColumn("_unit", F.min_by("_unit", F.when(~F.col("_capped"), F.struct(F.col("cap") / F.col("weight"), "sid")))
                     .over(everything))
    s = s.withColumn("target", F.when(F.col("_capped") | F.col("_unit").isNull(), F.col("cap"))
                     .otherwise(F.col("weight") * F.col("_unit")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MAX_REPEAT))))
    return s.select("source", "sid", "source_size", "source_rows", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _fly(rows: DataFrame, round_: int, seed: int, land: bool) -> DataFrame:
    """One round: rows (a, b, copy, sid, size, p, blk) with p moved by the flight of each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "copy"], kind="stable")
        rng = random.Random(f"{seed}/{round_}/{pdf['sid'].iloc[0]}/{pdf['blk'].iloc[0]}")
        pdf["p"] = flight(pdf["size"].astype(float).tolist(), pdf["p"].tolist(), rng, land)
        return pdf

    return cut(rows.groupBy("sid", "blk").applyInPandas(run, rows.schema)).drop("blk")


def _drawn(open_: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(a, b, copy, pick) for rows with a probability between 0 and 1."""
    done = []
    round_ = 0
    counts = sources.select("sid", F.col("source_rows").alias("n"))
    while True:
        most = counts.agg(F.max("n")).first()[0] or 0
        land = most <= block
        blocks = bounded(counts.select("sid", F.ceil(F.col("n") / block).alias("blocks")))
        rows = open_.join(blocks, "sid")
        blk = F.lit(0).cast("long") if land else F.pmod(F.xxhash64(F.lit(seed + round_), "a", "b", "copy"), F.col("blocks"))
        rows = rows.withColumn("blk", blk).drop("blocks")
        flown = _fly(rows.select("a", "b", "copy", "sid", "size", "p", "blk"), round_, seed, land)
        done.append(flown.where("p = 0 OR p = 1"))
        if land:
            break
        open_ = flown.where("p > 0 AND p < 1")
        counts = cut(open_.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))
        round_ += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("a", "b", "copy", F.col("p").cast("int").alias("pick"))


def choose(light: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Rows of ``light`` (a, b, copy, source, size) with ``source_size``, ``target`` and ``times`` (0..3).

    (a, b, copy) identifies a row.
    """
    sources = stored(targets(light))
    by = bounded(sources)
    rows = light.join(by, light["source"].eqNullSafe(by["source"])).drop(by["source"])
    rows = rows.withColumn("whole", F.floor(F.col("rate") + EPS)).withColumn("p", F.col("rate") - F.col("whole"))
    rows = rows.withColumn("p", F.when(F.col("p") < EPS, 0.0).otherwise(F.col("p")))
    drawn = _drawn(rows.where("p > 0").select("a", "b", "copy", "sid", "size", "p"), sources, block, seed)
    return (rows.join(drawn, ["a", "b", "copy"], "left")
            .withColumn("times", (F.col("whole") + F.coalesce("pick", F.lit(0))).cast("int"))
            .drop("whole", "p", "pick", "rate", "sid", "source_rows"))


def digest(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Contract columns of every row of ``docs`` (doc_id, text, source)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    a, b = row_key([F.col(c) for c in rows.columns])
    light = expand(collapse_repeats(stored(rows), "n"), "n", "copy").drop("n").withColumns({"a": a, "b": b})
    out = choose(light, block, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (0 to 3 times), columns unchanged."""
    a, b, n, t, i = fresh(docs, "_m", 5)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ka, kb = row_key(row_columns(docs))
    once = collapse_repeats(docs, n).withColumns({a: ka, b: kb})
    light = stored(once.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("source").alias("source"),
                               word_count(F.col("text")).alias("size"), F.col(n).alias("n")))
    times = (choose(expand(light, "n", "copy").drop("n"), block, seed)
             .groupBy("a", "b").agg(F.sum("times").alias(t)).where(F.col(t) > 0)
             .select(F.col("a").alias(a), F.col("b").alias(b), t))
    return expand(once.join(times, [a, b]), t, i).select(*columns)
