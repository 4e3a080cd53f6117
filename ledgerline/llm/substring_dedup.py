"""Substring dedup by recompression: which words stand in a 50-word window that also starts in a smaller document.

Recompression shortens a sequence in rounds. A round first names every run of
one symbol (symbol, length), then splits the symbols into left and right ones
and names every neighbouring pair (left, right). A name is a fingerprint of
what it stands for, so every task gives equal runs and pairs equal names.
Inside equal word sequences all symbols are equal but for those near the
ends, whose naming looked at words outside. Each symbol therefore carries its
*reach*: the words that its naming has looked at. Two equal windows hold the
same symbols of a reach inside the window, at the same places, whatever
stands around them.

Spark's rounds bring the names together, from low symbols to high ones:

1. ``name_round`` gives each window the smallest of its highest symbols, as
   runs of windows that share one (about one row per 20 words). A symbol is
   read together with the words of its reach. Windows whose symbol stands in
   one document only are done; the documents that still have windows are
   written as a table.
2. The same with higher symbols for the windows that are left. A run now
   carries the fingerprint of all words that its windows see. Runs of equal
   words have equal windows: those outside the smallest document are covered
   as a whole.
3. Where a symbol stands in several runs of different words, the windows of
   the first run of each are compared by a 128-bit name of their 50 words.

All grouping is by aggregates with map-side combining followed by joins with
one row per name. A name with more than a hundredth of all rows (there are
less than a hundred of these) is broadcast, so a passage that stands in a
third of all documents never lands whole in one task. A long
document is named in segments that overlap by a window: reaches beyond a
segment's end reach out of all its windows, so segments change no symbol that
counts.

Defined results: a null text has no word; a text of less than 50 words keeps
all. A null doc_id counts as the largest integer. Rows that share a doc_id
are not smaller than each other, so repeated rows fare alike. Extra columns
are ignored. doc_id is an integer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

LENGTH = 50               # words of a window
ROUNDS = (3, 5)           # naming rounds done before each exchange
BLOCK_WORDS = 400_000     # words named at once
SEGMENT = 200_000         # words of a long document named at once
TEXT_STEP = 1 << 20       # characters split into words at once
KNOWN_WORDS = 500_000     # fingerprints of words that a task remembers
HOT_SHARE = 100           # a name with more than one row in so many is broadcast
LAST = (1 << 63) - 1

WORD = re.compile(r"[^ \t-\r]+")
WHITE = re.compile(r"[ \t-\r]")
KEYS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

SEEDS = "seed long, a long, b long, doc long, row long, start int, n int"
WINDOWS = "a long, b long, doc long, row long, start int"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


# ---- words --------------------------------------------------------------------

class Known(dict):
    """word -> 64-bit fingerprint, forgotten when it has grown."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a text, a bounded part of it at a time."""
    at = 0
    while at < len(text):
        cut = WHITE.search(text, at + TEXT_STEP) if at + TEXT_STEP < len(text) else None
        end = cut.start() if cut else len(text)
        yield WORD.findall(text, at, end)
        at = end


def fingerprints(text: str, known: Known) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)) for ws in word_lists(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


# ---- names --------------------------------------------------------------------

def name(a: np.ndarray, b, salt: int) -> np.ndarray:
    """64-bit fingerprint of (a, b) under ``salt``."""
    h = (a ^ np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * KEYS[0]
    h ^= h >> np.uint64(32)
    h = (h + b) * KEYS[1]
    h ^= h >> np.uint64(29)
    h *= KEYS[2]
    h ^= h >> np.uint64(32)
    return h


def shorten(names, lo, hi, stop, level):
    """One round over symbols with reaches [lo, hi): runs, then pairs. ``stop`` marks the gaps between documents."""
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | stop[1:] | stop[:-1]
    at = np.flatnonzero(fresh)
    length = np.diff(at, append=len(names))
    low = lo[np.maximum(at - 1, 0)]
    high = hi[np.minimum(at + length, len(names) - 1)]
    names, stop = names[at], stop[at]
    many = length > 1
    names[many] = name(names[many], length[many].astype(np.uint64), 2 * level)
    side = ((names ^ (names >> np.uint64(31))) * KEYS[3] + np.uint64(level)) >> np.uint64(63) == 1
    left, right = side & ~stop, ~side & ~stop
    pair = left[:-1] & right[1:]
    second = np.append(False, pair)
    first = np.append(pair, False)
    out_lo, out_hi = low.copy(), high.copy()
    # a left symbol has looked at the one after it, a right one at the one before
    out_hi[:-1][left[:-1]] = high[1:][left[:-1]]
    alone = right & ~second
    out_lo[1:][alone[1:]] = low[:-1][alone[1:]]
    joined = np.flatnonzero(pair)
    names[joined] = name(names[joined], names[joined + 1], 2 * level + 1)
    keep = ~second
    return names[keep], out_lo[keep], out_hi[keep], stop[keep]


def spans_names(words: np.ndarray, longest: int, salt: int) -> list[np.ndarray]:
    """Names of the 1, 2, 4, ... words from each place, up to ``longest``."""
    out = [name(words, np.uint64(1), salt)]
    width = 1
    while 2 * width <= longest and len(out[-1]) > width:
        out.append(name(out[-1][:-width], out[-1][width:], salt + len(out)))
        width *= 2
    return out


def range_names(tables: list[np.ndarray], lo: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """Names of the word ranges [lo, lo + size): equal ranges, equal names."""
    power = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    out = np.zeros(len(lo), np.uint64)
    for k in np.unique(power):
        here = power == k
        a, n = lo[here], size[here]
        out[here] = name(tables[k][a], tables[k][a + n - (1 << int(k))] + n.astype(np.uint64), salt)
    return out


def smallest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the smallest value (the first of equals) of each range [begin, end), none empty."""
    best = np.arange(len(values))
    out = np.empty(len(begin), np.int64)
    size = end - begin
    width = 1
    while True:
        here = (size >= width) & (size < 2 * width)
        a, b = best[begin[here]], best[end[here] - width]
        out[here] = np.where(values[a] <= values[b], a, b)
        if not (size >= 2 * width).any():
            return out
        best = np.where(values[best[:-width]] <= values[best[width:]], best[:-width], best[width:])
        width *= 2


def window_symbols(words: np.ndarray, stop: np.ndarray, wanted: np.ndarray, top: int):
    """(symbol, level, reach start, reach size) for each window start in ``wanted``: the smallest highest symbol inside.

    ``symbol`` numbers occurrences. Every window finds one: a word's reach is the word.
    """
    names, places = words.copy(), np.arange(len(words))
    levels = [(names, places, places + 1)]
    gaps = stop
    for level in range(1, top + 1):
        names, lo, hi, gaps = shorten(*levels[-1], gaps, level)
        levels.append((names, lo, hi))
    symbol = np.full(len(wanted), -1, np.int64)
    rank, start, size = (np.zeros(len(wanted), np.int64) for _ in range(3))
    open_ = np.arange(len(wanted))
    offset = 0
    for level in range(top, -1, -1):
        names, lo, hi = levels[level]
        s = wanted[open_]
        below = np.cumsum(np.bincount(lo, minlength=len(words) + 1))
        ended = np.cumsum(np.bincount(hi, minlength=len(words) + 1))
        begin, end = np.where(s > 0, below[np.maximum(s - 1, 0)], 0), ended[s + LENGTH]
        has = end > begin
        at = smallest(names, begin[has], end[has]) if has.any() else np.empty(0, np.int64)
        mine = open_[has]
        symbol[mine], rank[mine], start[mine], size[mine] = offset + at, level, lo[at], hi[at] - lo[at]
        open_ = open_[~has]
        offset += len(names)
        if not len(open_):
            break
    return symbol, rank, start, size


# ---- blocks -------------------------------------------------------------------

class Block:
    """Segments of documents, one after another with a gap between them."""

    def __init__(self):
        self.pieces, self.size = [], 0

    def add(self, row: int, offset: int, words: np.ndarray, live: np.ndarray | None):
        self.pieces.append((row, offset, words, live))
        self.size += len(words) + 1

    def arrays(self):
        """(words, gaps, window starts wanted, row and place in the document of each word)."""
        gap = np.zeros(1, np.uint64)
        words = np.concatenate([gap] + [x for _, _, w, _ in self.pieces for x in (w, gap)])
        sizes = np.array([len(w) for _, _, w, _ in self.pieces], np.int64)
        begin = 1 + np.cumsum(sizes + 1) - sizes - 1
        stop = np.ones(len(words), bool)
        for b, n in zip(begin, sizes):
            stop[b:b + n] = False
        wanted = []
        for b, n, (_, _, _, live) in zip(begin, sizes, self.pieces):
            starts = np.arange(b, b + n - LENGTH + 1)
            wanted.append(starts if live is None else starts[live[:len(starts)]])
        return words, stop, np.concatenate(wanted), begin

    def located(self, at: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in the document) of places of the block."""
        piece = np.searchsorted(begin, at, side="right") - 1
        rows = np.array([p[0] for p in self.pieces], np.int64)
        offsets = np.array([p[1] for p in self.pieces], np.int64)
        return rows[piece], offsets[piece] + at - begin[piece]


def blocks(texts, lives, known: Known) -> Iterator[Block]:
    """Blocks of bounded size over texts; ``lives`` holds per text the window runs to look at as (starts, sizes), or None."""
    block = Block()
    for row, (text, live) in enumerate(zip(texts, lives)):
        if not text:
            continue
        words = fingerprints(text, known)
        mask = None
        if live is not None:
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, live[0], 1)
            np.add.at(edges, live[0] + live[1], -1)
            mask = np.cumsum(edges)[:-1] > 0
        for s in range(0, max(len(words) - LENGTH + 1, 0), SEGMENT):
            e = s + SEGMENT + LENGTH - 1
            if mask is None or mask[s:s + SEGMENT].any():
                block.add(row, s, words[s:e], None if mask is None else mask[s:e])
            if block.size >= BLOCK_WORDS:
                yield block
                block = Block()
    if block.pieces:
        yield block


def seeds_of(block: Block, top: int, contexts: bool) -> tuple[np.ndarray, ...]:
    """(row, seed, a, b, start, n): runs of windows with one symbol; a and b name all words they see (0 without contexts)."""
    words, stop, wanted, begin = block.arrays()
    symbol, level, reach, size = window_symbols(words, stop, wanted, top)
    new = np.ones(len(wanted), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (wanted[1:] != wanted[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(wanted))
    tables = spans_names(words, 2 * LENGTH if contexts else LENGTH, 100)
    seed = range_names(tables, reach[at], size[at], 7) ^ (level[at].astype(np.uint64) * KEYS[3])
    a = b = np.zeros(len(at), np.uint64)
    if contexts:
        a = range_names(tables, wanted[at], n + LENGTH - 1, 8)
        b = range_names(spans_names(words, 2 * LENGTH, 200), wanted[at], n + LENGTH - 1, 9)
    row, start = block.located(wanted[at], begin)
    return row, seed, a, b, start, n


def windows_of(block: Block) -> tuple[np.ndarray, ...]:
    """(row, a, b, start): the 128-bit names of the wanted windows."""
    words, _, wanted, begin = block.arrays()
    size = np.full(len(wanted), LENGTH)
    a = range_names(spans_names(words, LENGTH, 300), wanted, size, 10)
    b = range_names(spans_names(words, LENGTH, 400), wanted, size, 11)
    row, start = block.located(wanted, begin)
    return row, a, b, start


def _live(batch: pa.RecordBatch) -> list:
    """Per row of a batch the (starts, sizes) of its column ``live``, or None where there is none."""
    if "live" not in batch.schema.names:
        return [None] * batch.num_rows
    out = []
    for runs in batch.column("live"):
        v = runs.values
        out.append((v.field("start").to_numpy(zero_copy_only=False).astype(np.int64),
                    v.field("n").to_numpy(zero_copy_only=False).astype(np.int64)))
    return out


def _texts(batch: pa.RecordBatch):
    return (x.as_py() for x in batch.column("text"))


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.int32() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, k) for c, k in zip(columns, kinds)], names=names)


def name_round(docs: DataFrame, top: int, contexts: bool) -> DataFrame:
    """Runs of windows (SEEDS) of ``docs`` (doc, row, text, optionally live), named up to level ``top``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            for block in blocks(_texts(batch), _live(batch), known):
                row, seed, a, b, start, n = seeds_of(block, top, contexts)
                yield _batch(SEEDS, [seed, a, b, doc[row], key[row], start, n])
    return docs.mapInArrow(run, SEEDS)


def name_windows(docs: DataFrame) -> DataFrame:
    """The live windows (WINDOWS) of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            for block in blocks(_texts(batch), _live(batch), known):
                row, a, b, start = windows_of(block)
                yield _batch(WINDOWS, [a, b, doc[row], key[row], start])
    return docs.mapInArrow(run, WINDOWS)


# ---- exchanges ----------------------------------------------------------------

def attach(rows: DataFrame, names: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``names``, one row per key with the key's number of rows in ``uses``.

    A key of more than 1 / HOT_SHARE of the ``total`` rows is one of less than
    HOT_SHARE keys: these are broadcast, so a hot key's rows stay where they are.
    """
    hot = F.col("uses") > total // HOT_SHARE
    if not names.where(hot).limit(1).collect():
        return rows.join(names.drop("uses"), keys)
    many = F.broadcast(names.where(hot).drop("uses"))
    rest = rows.join(many.select(*keys), keys, "left_anti").join(names.where(~hot).drop("uses"), keys)
    return rows.join(many, keys).unionByName(rest)


def _gathered(runs: DataFrame, name_: str) -> DataFrame:
    """One row per document with its distinct runs of windows as an array (start, n): at most the document's words."""
    return (runs.select("doc", "row", "start", "n").distinct().groupBy("doc", "row")
            .agg(F.collect_list(F.struct("start", "n")).alias(name_)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def covered_windows(docs: DataFrame) -> DataFrame:
    """(doc, row, start, n): runs of windows that also start in a smaller document; ``row`` is the text's xxhash64."""
    live = _keyed(docs)
    several = F.col("least") < F.col("most")
    span = F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("uses")
    for i, top in enumerate(ROUNDS):
        last = i == len(ROUNDS) - 1
        runs = stored(name_round(live, top, last))
        open_ = (F.min("a") < F.max("a")) | (F.min("b") < F.max("b"))   # runs of different words share the symbol
        shared = stored(runs.groupBy("seed").agg(*span, open_.alias("open")).where(several).select("seed", "uses", "open"))
        runs = stored(attach(runs, shared, ["seed"], runs.count()))
        if not last:
            # a text that stands in several rows is looked at once per document
            spans = _gathered(runs, "live")
            live = stored(live.drop("live").join(spans, ["doc", "row"]).dropDuplicates(["doc", "row"]))
    words = ["seed", "a", "b"]
    firsts = stored(runs.groupBy(*words).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("uses")))
    found = stored(attach(runs, firsts, words, runs.count()).where("doc > first OR open")
                   .select("doc", "row", "start", "n", (F.col("doc") > F.col("first")).alias("whole")))
    spans = _gathered(found.where("NOT whole"), "live")
    windows = stored(name_windows(live.drop("live").join(spans, ["doc", "row"])))
    shared = stored(windows.groupBy("a", "b").agg(*span).where(several).select("a", "b", "uses", "least"))
    singles = attach(windows, shared, ["a", "b"], windows.count()).where("doc > least").select("doc", "row", "start", F.lit(1).alias("n"))
    return found.where("whole").select("doc", "row", "start", "n").unionByName(singles)


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text) per document: the words kept, joined by one space."""
    spans = _gathered(covered_windows(docs), "gone")
    # the id stays as it is; the join key is the id with null as the largest integer
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
            .withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(LAST)), "row": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
            .join(spans, ["doc", "row"], "left").select("doc_id", "text", "gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                text, gone = batch.column("text")[i].as_py() or "", batch.column("gone")[i]
                rows.append((batch.column("doc_id")[i].as_py(), *_kept(text, gone.values if gone.is_valid else None)))
                size += len(text)
                if size >= TEXT_STEP or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KEPT.types)], names=KEPT.names)
                    rows, size = [], 0
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def _kept(text: str, gone) -> tuple[int, int, str]:
    """(number of words, words removed, kept words joined by a space) for runs of covered windows."""
    words = [w for part in word_lists(text) for w in part]
    if gone is None:
        return len(words), 0, " ".join(words)
    start = gone.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    end = start + gone.field("n").to_numpy(zero_copy_only=False) + LENGTH - 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    out = np.cumsum(edges)[:-1] > 0
    return len(words), int(out.sum()), " ".join(w for w, x in zip(words, out.tolist()) if not x)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
