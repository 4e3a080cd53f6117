"""Benchmark decontamination: SimHash of item-sized windows in a multi-index of Hamming blocks.

A window of a document as long as a benchmark item (in words), or the whole
of a shorter document, is a leak of the item if their weighted word shingles (weight = number of repeats) have a
Jaccard similarity of at least ``SIMILARITY``. All windows that can reach it
are compared, in four steps, with DataFrame functions only:

1. Anchors. Similarity t over m shingles on each side needs at least
   ceil(2tm / (1 + t)) common ones, so at most d = m - that many places of
   the window differ, and of every s = m // (d + 1)-th place of the document
   at least one inside the window starts a shingle of the item. Only those
   places are hashed and looked up: no window is lost, and a document
   without an anchor goes no further. A whole document of m' < m shingles
   differs in at most (m' - tm) / (1 + t) <= d m' / m places, so the same
   spacing meets it in a common one.
2. Windows. Every window of an item's length that holds an anchor, and every
   shorter document that holds one, gets a 64-bit SimHash of its shingles.
3. Multi-index. The fingerprint is cut into RADIUS + 1 blocks; fingerprints
   within RADIUS bits agree in at least one block, so an equi-join on
   (length, anchor, block, value) finds all of them: a window at the bound
   holds, by step 1, an anchor that starts a shingle of that very item, so the
   anchor's hash is part of the key and a window meets only items that it
   shares an anchor with. The bit distance is then exact.
4. Verification on the shingle texts themselves.

The benchmark is the stated query set: its shingle hashes are looked up in
blocks of at most ``LOOKUP`` hashes, one scan of the documents for each. Equal
texts share one key, so groups of copies are looked at once after map-side
combining. RADIUS is chosen so wide (24 blocks) that a window at the
similarity bound, whose expected distance is under 10 bits, stays inside.

Defined results: null or blank texts and items have no windows. An item of
fewer than five words is one shingle of all its words. Repeated rows each
get their leaks. Extra columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded, content_key, fresh, stored, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
LOOKUP = 20_000
LANES = 32


def _shingle_hash(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, i + j) for j in range(k)])


def _shingles(w: Column, m: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.array_join(F.slice(w, i + 1, k), " "))


def _fingerprints(rows: DataFrame, keys: list[str], w: str, k: int) -> DataFrame:
    """(keys, fp): SimHash of the shingles of the words in ``w``, ``m`` of them in each row.

    Majority per bit, repeats included. Each of 32 sums holds two 32-bit
    counters (bits j and j + 32), enough for any array of words; the sums are
    combined in the task that reads the window.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: _shingle_hash(F.col(w), i, k))
    mask = F.lit(0x0000000100000001).cast("long")
    sums = (rows.select(*keys, "m", F.explode(hashes).alias("h")).groupBy(*keys, "m")
            .agg(*[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(mask)).alias(f"s{j}") for j in range(LANES)]))
    fp = F.lit(0).cast("long")
    for bit in range(64):
        count = F.shiftrightunsigned(f"s{bit % LANES}", bit // LANES * LANES).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        one = (1 << bit) - (1 << 64) * (bit == 63)
        fp = fp.bitwiseOR(F.when(2 * count > F.col("m"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(offset, width) of radius + 1 blocks that share 64 bits as evenly as possible."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_value(x: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1).cast("long"))


def stride(m: int, similarity: float = SIMILARITY) -> int:
    """Widest spacing of places that meets every window of ``m`` shingles in a common one."""
    common = -int(-(2 * similarity * m / (1 + similarity) - 1e-9) // 1)
    return max(1, m // (m - common + 1))


def _items(benchmark: DataFrame) -> DataFrame:
    """One row per distinct item text: (ik, k, m, len, w)."""
    w = words(F.lower("text"))
    items = benchmark.select(w.alias("w")).where(F.size("w") > 0).distinct()
    n = F.size("w")
    return items.select(F.xxhash64("w").alias("ik"), F.least(n, F.lit(SHINGLE_WORDS)).alias("k"), n.alias("len"),
                        F.greatest(n - SHINGLE_WORDS + 1, F.lit(1)).alias("m"), "w")


def _similarity(item: Column, window: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles."""
    plain = (F.size(F.array_distinct(item)) == F.size(item)) & (F.size(F.array_distinct(window)) == F.size(window))

    def times(a, x):
        return F.size(F.filter(a, lambda y: y == x))

    repeats = F.aggregate(F.array_distinct(item), F.lit(0), lambda acc, x: acc + F.least(times(item, x), times(window, x)))
    common = F.when(plain, F.size(F.array_intersect(item, window))).otherwise(repeats)
    return common / (F.size(item) + F.size(window) - common)


def _anchors(docs: DataFrame, shingles: DataFrame, k: int, step: int, hashes: list[int], similarity: float) -> DataFrame:
    """(c1, c2, len, m, p, h, lo, n, last, part): looked-up places that start a shingle ``h`` of an item, once for each text and length.

    ``docs`` has (c1, c2, w); ``shingles`` has (hash, len, m) of the items. The anchor stands in the windows that start
    at ``lo`` to ``last``; ``part`` holds their words. A document of ``n`` words that is shorter than an item is one window,
    unless even all of its shingles are too few.
    """
    w = F.col("w")
    # No filter on the places: it would be pushed below the projection and split the text again for each.
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)), F.lit(step)), lambda i: F.struct(
        i.alias("p"), _shingle_hash(w, i, k).alias("h")))
    listed = ",".join(f"{h}L" for h in hashes)
    held = docs.select("c1", "c2", "w", every.alias("_h")).select(
        "c1", "c2", "w", F.expr(f"explode(filter(_h, x -> x.h IN ({listed})))").alias("a"))
    lo = F.greatest(F.col("a.p") - F.col("m") + 1, F.lit(0))
    anchors = (held.join(bounded(shingles), F.col("a.h") == F.col("hash"))
               .select("c1", "c2", "len", "m", F.col("a.p").alias("p"), F.col("a.h").alias("h"), lo.alias("lo"), F.size("w").alias("n"),
                       F.slice("w", lo + 1, 2 * F.col("len")).alias("part")))
    enough = F.least(F.col("n"), F.col("len")) - k + 1 >= similarity * F.col("m") - 1e-9
    once = anchors.where(enough).groupBy("c1", "c2", "len", "m", "p").agg(
        *[F.first(c).alias(c) for c in ("h", "lo", "n", "part")])
    last = F.least(F.col("p"), F.greatest(F.col("n") - F.col("len"), F.lit(0)))
    return once.withColumn("last", last).where("lo <= last")


def _windows(anchors: DataFrame, k: int) -> DataFrame:
    """(c1, c2, len, m, s, win): every window that holds an anchor, once; ``len`` is the item's, ``m`` counts the window's shingles."""
    # a window belongs to the first anchor that it holds
    before = F.lag("p").over(Window.partitionBy("c1", "c2", "len").orderBy("p"))
    first = F.greatest(F.col("lo"), F.coalesce(before + 1, F.lit(0)))
    return (anchors.withColumn("first", first).where("first <= last").withColumn("s", F.explode(F.sequence("first", "last")))
            .select("c1", "c2", "len", (F.least(F.col("n"), F.col("len")) - k + 1).alias("m"), "s",
                    F.slice("part", F.col("s") - F.col("lo") + 1, F.col("len")).alias("win")))


WINDOW_ID = ["c1", "c2", "len", "s"]


def _keyed(df: DataFrame, blocks: list[tuple[int, int]], *cols: str) -> DataFrame:
    """``cols`` with (blk, val) for each block of the fingerprint ``fp``."""
    return df.select(*cols, F.posexplode(F.array(*[_block_value(F.col("fp"), b) for b in blocks])).alias("blk", "val"))


def _index(own: DataFrame, k: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """(len, h, blk, val, ik, ifp): the items by their shingles' hashes and fingerprint blocks."""
    prints = _fingerprints(own, ["ik", "len"], "w", k)
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: _shingle_hash(F.col("w"), i, k)))
    each = own.select("ik", F.explode(hashes).alias("h")).join(prints, "ik").withColumn("ifp", F.col("fp"))
    return _keyed(each, blocks, "len", "h", "ik", "ifp")


def _candidates(win: DataFrame, anchors: DataFrame, index: DataFrame, k: int, blocks: list[tuple[int, int]]) -> DataFrame:
    """(window, ik, fp, ifp, blk) for every anchor and block in which a window and an item agree."""
    marks = anchors.select("c1", "c2", "len", "h", F.explode(F.sequence("lo", "last")).alias("s"))
    prints = _fingerprints(win, WINDOW_ID, "win", k).join(marks, WINDOW_ID)
    return _keyed(prints, blocks, *WINDOW_ID, "h", "fp").join(index, ["len", "h", "blk", "val"])


def _found(docs: DataFrame, items: DataFrame, k: int, similarity: float, radius: int) -> DataFrame | None:
    """(c1, c2, ik, position, similarity, distance) for items of shingle length ``k``."""
    own = items.where(F.col("k") == k)
    sizes = [r["m"] for r in own.select("m").distinct().collect()]
    if not sizes:
        return None
    step = min(stride(m, similarity) for m in sizes)
    w, m = F.col("w"), F.col("m")
    places = own.select("len", "m", F.explode(F.transform(F.sequence(F.lit(0), m - 1),
                                                          lambda i: _shingle_hash(w, i, k))).alias("hash")).distinct()
    places = stored(places)
    n = places.select("hash").distinct().count()
    passes = -(-n // LOOKUP)
    own = stored(own.select("ik", "len", "m", "w"))
    blocks = _blocks(radius)
    index = bounded(stored(_index(own, k, blocks)))
    shingles = own.select("ik", _shingles(w, m, k).alias("sh"))
    out = None
    for b in range(passes):
        mine = F.pmod(F.xxhash64("hash"), F.lit(passes)) == b
        hashes = [r["hash"] for r in places.where(mine).select("hash").distinct().collect()]
        anchors = stored(_anchors(docs, places.where(mine), k, step, hashes, similarity))
        win = stored(_windows(anchors, k))
        x = F.col("fp").bitwiseXOR(F.col("ifp"))
        # a pair is looked at by the first block in which it agrees, and once for all anchors that it shares
        first = F.least(*[F.when(_block_value(x, blk) == 0, F.lit(i)).otherwise(F.lit(len(blocks)))
                          for i, blk in enumerate(blocks)])
        near = (_candidates(win, anchors, index, k, blocks).withColumn("distance", F.bit_count(x))
                .where((F.col("distance") <= radius) & (first == F.col("blk"))).select(*WINDOW_ID, "ik", "distance").distinct())
        both = near.join(win, WINDOW_ID).join(shingles, "ik").select(
            "c1", "c2", "ik", "s", "distance", F.struct("sh", _shingles(F.col("win"), m, k).alias("wsh")).alias("x"))
        # the one-element array binds the window's shingles to a name, so they are built once
        sim = F.get(F.transform(F.array("x"), lambda v: _similarity(v["sh"], v["wsh"])), F.lit(0))
        hit = (stored(both.select("c1", "c2", "ik", F.col("s").alias("position"), sim.alias("similarity"), "distance"))
               .where(F.col("similarity") >= similarity - 1e-12))
        out = hit if out is None else out.union(hit)
    return out


def leaking_texts(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Best window of each (text, item): (c1, c2, ik, position, similarity, distance); (c1, c2) is the text's key."""
    c1, c2 = content_key(F.col("text"))
    keyed = docs.select(c1.alias("c1"), c2.alias("c2"), words(F.lower("text")).alias("w"))
    items = stored(_items(benchmark))
    parts = [_found(keyed, items, k, similarity, radius) for k in range(1, SHINGLE_WORDS + 1)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return docs.sparkSession.createDataFrame(
            [], "c1 bigint, c2 bigint, ik bigint, position int, similarity double, distance int")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = F.max_by(F.struct("position", "similarity", "distance"),
                    F.struct("similarity", -F.col("position"))).alias("best")
    return stored(every.groupBy("c1", "c2", "ik").agg(best).select("c1", "c2", "ik", "best.*"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, position, similarity, distance): the best window (by similarity, then the first)
    of every document and benchmark item at or above ``similarity``."""
    found = bounded(leaking_texts(docs, benchmark, similarity, radius))
    c1, c2 = content_key(F.col("text"))
    light = docs.select("doc_id", c1.alias("c1"), c2.alias("c2"))
    named = benchmark.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    named = named.select("item_id", F.xxhash64("w").alias("ik"))
    return (light.join(found, ["c1", "c2"]).join(named, "ik")
            .select("doc_id", "item_id", "position", "similarity", "distance"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without a leak, columns unchanged."""
    a, b = fresh(docs, "_c", 2)
    found = leaking_texts(docs, benchmark, similarity, radius).select(F.col("c1").alias(a), F.col("c2").alias(b)).distinct()
    c1, c2 = content_key(F.col("text"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumns({a: c1, b: c2}).join(bounded(stored(found)), [a, b], "left_anti").select(*columns)
