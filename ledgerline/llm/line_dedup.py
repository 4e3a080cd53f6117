"""Line dedup on repeated runs of lines, found by a rolling hash over line hashes.

``dedup_runs`` (the query) splits each text at line feeds and hashes every
``MIN_LINES`` neighbouring lines. A run of at least ``MIN_LINES`` lines that
occurs earlier (smaller doc_id, or earlier in the same document without an
overlap) is removed; the first occurrence of each pair of lines stays. Every
such run consists of pairs that occur earlier, and the other way round, so
whatever stands around a passage, all of it is found. Pairs without a
character other than white space nominate nothing.

Equal hashes only nominate: neighbouring pairs whose first occurrences are
neighbours too are joined to the longest run, and a run is removed after its
bytes equal those of the first occurrence.

DataFrame functions only. Hashes of pairs (no texts) are counted first, with
map-side combining, so a line that stands in a third of all documents is one
row per task; only places of repeated pairs and texts of documents that hold
one are moved.

``dedup`` is the coarser form on content-defined chunks: a rolling hash over
``WINDOW`` line hashes ends a chunk at one place in ``DIVISOR`` on average,
and only whole chunks are removed; repeats without a whole chunk stay.

Defined results: a null text has no lines and stays null; rows equal in
doc_id and text count as one document (each row gets its result); a null
doc_id comes last in the order. Extra columns are ignored by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import WHITE, bounded, row_key, stored

WINDOW = 2
DIVISOR = 3
MIN_LINES = 2

CHUNK = ["h1", "h2"]
DOC = ["k1", "k2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _chunked(docs: DataFrame, divisor: int, min_lines: int, *keep: str) -> DataFrame:
    """(keep, lines, start, n, h1, h2) of every chunk of at least ``min_lines`` lines that holds a character."""
    d = docs.select(*keep, _lines(F.col("text")).alias("lines"))
    d = d.select(*keep, "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))
    h = F.col("hs")
    n = F.size("hs")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (
        F.pmod(F.xxhash64(*[F.get(h, i - k) for k in range(WINDOW, 0, -1)]), F.lit(divisor)) == 0))
    d = d.select(*keep, "lines", "hs", ends.alias("ends"))
    e = F.col("ends")
    spans = F.transform(e, lambda x, j: F.struct(F.coalesce(F.get(e, j - 1), F.lit(0)).alias("start"), x.alias("end")))
    wanted = F.filter(spans, lambda s: s["end"] - s["start"] >= min_lines)
    d = d.select(*keep, "lines", "hs", F.explode(wanted).alias("s"))
    part = F.slice("hs", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return d.select(*keep, "lines", F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start")).alias("n"),
                    F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("chunk"), part).alias("h2"))


def _pairs(docs: DataFrame, min_lines: int, *keep: str) -> DataFrame:
    """(keep, start, h1, h2) of every ``min_lines`` neighbouring lines that hold a character."""
    d = docs.select(*keep, _lines(F.col("text")).alias("lines"))
    # a line without a character has no hash of its own: null
    d = d.select(*keep, F.transform("lines", lambda x: F.when(F.btrim(x, F.lit(WHITE)) != "", F.xxhash64(x))).alias("full"),
                 F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))
    n = F.size("hs")
    starts = F.when(n >= min_lines, F.sequence(F.lit(0), n - min_lines)).otherwise(F.array().cast("array<int>"))
    wanted = F.filter(starts, lambda i: F.coalesce(*[F.get("full", i + k) for k in range(min_lines)]).isNotNull())
    d = d.select(*keep, F.explode(F.transform(wanted, lambda i: F.struct(
        i.alias("start"), F.array(*[F.get("hs", i + k) for k in range(min_lines)]).alias("part")))).alias("s"))
    return d.select(*keep, F.col("s.start").alias("start"), F.xxhash64("s.part").alias("h1"),
                    F.xxhash64(F.lit("chunk"), F.col("s.part")).alias("h2"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(k1, k2, f1, f2, start, first, n): every longest run of n lines whose pairs occur earlier at neighbouring places.

    ``docs`` has (k1, k2, doc_id, text); the first occurrences are in document (f1, f2) from line ``first``.
    """
    often = bounded(stored(_pairs(docs, min_lines).groupBy("h1").count().where("count > 1").select("h1")))
    pairs = stored(_pairs(docs, min_lines, *DOC, "doc_id").join(often, "h1", "left_semi").select(
        *CHUNK, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *DOC, "start").alias("place")))
    first = stored(pairs.groupBy(*CHUNK).agg(F.min("place").alias("first"), F.max("place").alias("last"))
                   .where("first < last").drop("last"))
    apart = (F.col("place.k1") != F.col("first.k1")) | (F.col("place.k2") != F.col("first.k2")) | (
        F.col("place.start") >= F.col("first.start") + min_lines)
    hits = pairs.join(first, CHUNK).where((F.col("place") > F.col("first")) & apart).select(
        "place.k1", "place.k2", F.struct(F.col("place.start").alias("start"), F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"),
                                         F.col("first.start").alias("first")).alias("x"))
    d = hits.groupBy(*DOC).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    xs, n = F.col("xs"), F.size("xs")

    def breaks(i):
        a, b = F.get(xs, i - 1), F.get(xs, i)
        return (i == 0) | (b["start"] != a["start"] + 1) | (b["first"] != a["first"] + 1) | (b["f1"] != a["f1"]) | (b["f2"] != a["f2"])

    d = d.select(*DOC, "xs", F.filter(F.sequence(F.lit(0), n - 1), breaks).alias("at"))
    at = F.col("at")
    runs = F.transform(at, lambda i, j: F.struct(
        F.get(xs, i).alias("x"), (F.coalesce(F.get(at, j + 1), n) - i + (min_lines - 1)).alias("n")))
    return d.select(*DOC, F.explode(runs).alias("r")).select(*DOC, "r.x.f1", "r.x.f2", "r.x.start", "r.x.first", "r.n")


def _text(lines: str, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(k1, k2, start, n, h1, h2, first): every chunk seen before; ``first`` is the place of the first one.

    ``docs`` has (k1, k2, doc_id, text); a place is (no id, doc_id, k1, k2, start).
    """
    chunks = _chunked(docs, divisor, min_lines, *DOC, "doc_id").select(
        *DOC, "start", "n", *CHUNK,
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *DOC, "start").alias("place"))
    # written, so that both sides of the join are plain exchanges, which adaptive execution can split
    first = stored(chunks.groupBy(*CHUNK).agg(F.min("place").alias("first"), F.max("place").alias("last"))
                   .where("first < last").drop("last"))
    return chunks.join(first, CHUNK).where("place > first").select(*DOC, "start", "n", *CHUNK, "first")


def dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every row of ``docs`` (doc_id, text) without its repeated chunks."""
    k1, k2 = row_key([F.col("doc_id"), F.col("text")])
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    seen = stored(repeated_chunks(keyed, divisor, min_lines).distinct())

    # texts of the nominated chunks: the first occurrences and the repeats
    own = seen.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", *CHUNK)).alias("repeats"))
    firsts = (seen.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"),
                          F.struct(F.col("first.start").alias("start"), "n", *CHUNK).alias("x")).distinct()
              .groupBy(*DOC).agg(F.collect_list("x").alias("firsts")))
    marks = stored(own.join(firsts, DOC, "full_outer"))
    held = stored(keyed.join(marks, DOC).select(*DOC, "text", "repeats", "firsts").dropDuplicates(DOC))

    def texts(which: str) -> DataFrame:
        d = held.select(*DOC, _lines(F.col("text")).alias("lines"), F.explode(which).alias("x"))
        return d.select(*DOC, "x.*", _text("lines", F.col("x.start"), F.col("x.n")).alias("part"))

    same = (texts("repeats").join(texts("firsts").select(*CHUNK, F.col("part").alias("first_part")), CHUNK)
            .where(F.col("part") == F.col("first_part")))
    return _without(keyed, held, same)


def dedup_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every row of ``docs`` (doc_id, text) without its repeated runs of lines."""
    k1, k2 = row_key([F.col("doc_id"), F.col("text")])
    keyed = docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    runs = stored(repeated_runs(keyed, min_lines))
    run = ["f1", "f2", "first", "n"]

    own = runs.groupBy(*DOC).agg(F.collect_list(F.struct("start", *run)).alias("repeats"))
    firsts = (runs.select(F.col("f1").alias("k1"), F.col("f2").alias("k2"), F.struct(F.col("first").alias("start"), *run).alias("x"))
              .distinct().groupBy(*DOC).agg(F.collect_list("x").alias("firsts")))
    marks = stored(own.join(firsts, DOC, "full_outer"))
    held = stored(keyed.join(marks, DOC).select(*DOC, "text", "repeats", "firsts").dropDuplicates(DOC))

    def texts(which: str) -> DataFrame:
        d = held.select(*DOC, _lines(F.col("text")).alias("lines"), F.explode(which).alias("x"))
        return d.select(*DOC, "x.*", _text("lines", F.col("x.start"), F.col("x.n")).alias("part"))

    same = (texts("repeats").join(texts("firsts").select(*run, F.col("part").alias("first_part")), run)
            .where(F.col("part") == F.col("first_part")))
    return _without(keyed, held, same)


def _without(keyed: DataFrame, held: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of ``keyed`` without the confirmed spans ``same`` (k1, k2, start, n); ``held`` has the documents' texts."""
    removed = same.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    d = held.join(removed, DOC).select(*DOC, _lines(F.col("text")).alias("lines"), "spans")
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    d = d.select(*DOC, "lines", left.alias("left"))
    lines = F.col("lines")
    cleaned = d.select(*DOC, F.array_join(F.transform("left", lambda i: F.get(lines, i)), "\n").alias("kept"),
                       (F.size("lines") - F.size("left")).cast("long").alias("gone"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long")
    return (keyed.join(cleaned, DOC, "left")
            .select("doc_id", F.coalesce("kept", "text").alias("text"), n_lines.alias("n_lines"),
                    F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed")))
