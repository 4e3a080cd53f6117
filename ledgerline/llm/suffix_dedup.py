"""Suffix-array dedup: which bytes stand in a 100-byte string that also starts earlier.

Distributed prefix doubling, kept sparse. A rank of a byte string is its
64-bit name (equal strings, equal names); names of twice the length come
from pairs of names at a growing offset: 8 bytes at each place, then 16 and
32, all inside the task that reads the text. Sorting every place of the
corpus by its ranks would move many times the input, so the places are first
thinned without losing a match:

1. Every 100-byte window has an *anchor*: the 32-byte string inside with the
   smallest name (the first of equals). Equal windows have equal anchors at
   equal offsets, and neighbouring windows share theirs, so a document is a
   row of runs of windows, one per anchor (about 3 % of the bytes).
2. Anchors are shuffled by their 32-byte rank and sorted by (rank, context
   rank, place), the context being all bytes that a window over the anchor
   can see. An anchor of a rank of its own is unique: its windows are done.
   Anchors of equal context have equal windows: all but the first are
   covered as a whole.
3. Where a rank has several contexts, the comparison goes past the threshold
   length itself: the windows of the first anchor of each context are ranked
   over their 100 bytes, shuffled and sorted by (rank, place); every window
   but the first of a rank is covered.

Each shuffle sends at most one row per task and rank (the rest is settled
map-side), so a passage or a text that stands in a third of all documents
meets nobody's limit; rows travel as packed columns, one record per task and
bucket, and the number of buckets follows the bytes of the input.

Names have 64 bits for anchors and contexts (compared together) and 128 bits
for windows.

Defined results: a null text is empty; a text under 100 bytes keeps all its
bytes. A null doc_id comes after all others. Places are compared by doc_id
and start alone, so repeated rows, and rows that share a doc_id, are not
earlier than each other. Extra columns are ignored. doc_id is an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored

LENGTH = 100          # threshold in bytes
CORE = 32             # length of an anchor's string
WINDOW = LENGTH - CORE + 1
LEFT = LENGTH - CORE  # bytes before an anchor that a window over it can see
PAD = LEFT + LENGTH
MARGIN = 2 * PAD
BLOCK_BYTES = 2 << 20
FLUSH_ROWS = 1_500_000
BUCKET_BYTES = 8 << 20
# Spans and places to look at are broadcast below this many bytes, else joined by document.
SIDE_BYTES = 64 << 20

LAST = (1 << 63) - 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]

ANCHOR = np.dtype([("g", "<u8"), ("x", "<u8"), ("doc", "<i8"), ("k", "<u4"), ("lo", "<u4"), ("n", "u1"), ("f", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("k", "<u4"), ("lo", "<u4"), ("hi", "<u4")])
NAMED = np.dtype([("g", "<u8"), ("x", "<u8"), ("doc", "<i8"), ("k", "<u4"), ("lo", "<u4")])
KINDS = {"anchor": ANCHOR, "context": ANCHOR, "look": ANCHOR, "span": SPAN, "window": NAMED}
PACKED = "kind string, bucket int, data binary"


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of ``buf`` as numbers (a view)."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))


def _name(view: np.ndarray, at: np.ndarray, length: int, salt: int, seed=0) -> np.ndarray:
    """64-bit names of the ``length`` bytes from each place ``at``."""
    k = MIX[salt]
    acc = np.full(len(at), seed, np.uint64) + MIX[salt + 1]
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        acc ^= view[at + j]
        acc *= k
        acc ^= acc >> np.uint64(31)
    return acc


def block_anchors(pieces: list[tuple[int, bytes, int, int, int]]) -> np.ndarray:
    """Anchors of pieces (number, bytes, first byte's place, first and end place to report) of documents.

    ``pieces`` hold MARGIN bytes around what they report, where the document
    has them. The result has the piece's number in ``doc``.
    """
    gap = bytes(PAD)
    buf = np.frombuffer(gap + gap.join(b for _, b, *_ in pieces) + gap + bytes(CORE + 8), np.uint8)
    view = _words(buf)
    sizes = np.array([len(b) for _, b, *_ in pieces], np.int64)
    begin = PAD + np.cumsum(sizes + PAD) - sizes - PAD
    count = np.maximum(sizes - LENGTH + 1, 0)
    if not count.sum():
        return np.empty(0, ANCHOR)
    # ranks of 8, 16 and 32 bytes
    t = view * MIX[0]
    t ^= t >> np.uint64(32)
    t = t[:-8] * MIX[1] + t[8:]
    t ^= t >> np.uint64(29)
    t = t[:-16] * MIX[2] + t[16:]
    t ^= t >> np.uint64(32)
    t *= MIX[3]
    low = (t & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(t), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (WINDOW - width)], low[WINDOW - width:])

    which = np.repeat(np.arange(len(pieces)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[which] + place
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (which[1:] != which[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    which, anchor = which[first], anchor[first]
    base = np.array([p[2] for p in pieces], np.int64)[which]
    inside = anchor - begin[which]
    # an anchor belongs to the piece that reports its place
    here = (base + inside >= np.array([p[3] for p in pieces])[which]) & (base + inside < np.array([p[4] for p in pieces])[which])
    first, last, which, anchor, base, inside = (v[here] for v in (first, last, which, anchor, base, inside))
    out = np.empty(len(first), ANCHOR)
    cut = np.minimum(inside, LEFT) * 256 + np.minimum(sizes[which] - inside, LENGTH)
    out["g"], out["x"] = t[anchor], _name(view, anchor - LEFT, PAD, 1, cut.astype(np.uint64))
    out["doc"], out["k"], out["f"] = np.array([p[0] for p in pieces])[which], 0, 0
    out["lo"], out["n"] = base + place[first], last - first
    return out


def text_anchors(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Anchors of texts, in blocks of bounded size; ``doc`` is the text's number."""
    held, size = [], 0
    for i, b in enumerate(texts):
        for s in range(0, max(len(b), 1), BLOCK_BYTES):
            e = min(len(b), s + BLOCK_BYTES) if s + BLOCK_BYTES < len(b) else len(b)
            a = max(0, s - MARGIN)
            piece = b[a:e + MARGIN]
            held.append((i, piece, a, s, e))
            size += len(piece) + PAD
            if size >= BLOCK_BYTES:
                yield block_anchors(held)
                held, size = [], 0
    if held:
        yield block_anchors(held)


def _pack(rows: np.ndarray) -> bytes:
    """Columns one after another, equal bytes of the numbers together (compresses well)."""
    return b"".join(np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in rows.dtype.names)


def _unpack(kind: np.dtype, blobs) -> np.ndarray:
    parts = []
    for b in blobs:
        n = len(b) // kind.itemsize
        out, at = np.empty(n, kind), 0
        for c in kind.names:
            w = kind[c].itemsize
            raw = np.frombuffer(b, np.uint8, n * w, at).reshape(w, n).T
            out[c] = np.ascontiguousarray(raw).view(kind[c]).reshape(n)
            at += n * w
        parts.append(out)
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _dealt(kind: str, rows: np.ndarray, key: np.ndarray, buckets: int) -> pd.DataFrame:
    """Rows as one record per bucket of ``key``."""
    b = ((key.astype(np.uint64) * MIX[4]) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    rows, b = rows[order], b[order]
    ids, first = np.unique(b, return_index=True)
    parts = np.split(rows, first[1:]) if len(ids) else []
    return pd.DataFrame({"kind": kind, "bucket": ids.astype(np.int32), "data": [_pack(p) for p in parts]})


def _joined_key(rows: np.ndarray) -> np.ndarray:
    return rows["g"] ^ (rows["x"] * MIX[0])


def _same(rows: np.ndarray, *cols: str) -> np.ndarray:
    """For sorted rows: whether a row equals the one before in ``cols``."""
    same = np.zeros(len(rows), bool)
    if len(rows):
        same[1:] = True
        for c in cols:
            same[1:] &= rows[c][1:] == rows[c][:-1]
    return same


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each (g, x) by place, rows at later places)."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["x"], rows["g"]))]
    later = _same(rows, "g", "x")
    start = np.flatnonzero(~later)
    group = np.cumsum(~later) - 1
    lead = rows[start]
    moved = later & ((rows["doc"] != lead["doc"][group]) | (rows["lo"] != lead["lo"][group]))
    return lead, rows[moved]


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of each document joined; sorted by document."""
    s = spans[np.lexsort((spans["lo"], spans["k"], spans["doc"]))]
    if not len(s):
        return s
    group = np.cumsum(~_same(s, "doc", "k")) - 1
    reach = np.maximum.accumulate(group * (1 << 33) + s["hi"].astype(np.int64)) - group * (1 << 33)
    new = np.ones(len(s), bool)
    new[1:] = (group[1:] != group[:-1]) | (s["lo"][1:] > reach[:-1])
    first = np.flatnonzero(new)
    out = s[first]
    out["hi"] = reach[np.append(first[1:], len(s)) - 1]
    return out


def _run_spans(rows: np.ndarray) -> np.ndarray:
    """Bytes covered by all windows of the anchors' runs."""
    out = np.empty(len(rows), SPAN)
    for c in ("doc", "k", "lo"):
        out[c] = rows[c]
    out["hi"] = rows["lo"] + rows["n"] + LENGTH if "n" in rows.dtype.names else rows["lo"] + LENGTH
    return merged(out)


def _spans(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    s = _run_spans(rows)
    return _dealt("span", s, s["doc"], buckets)


def _frames(*frames: pd.DataFrame) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True)


def _settle_anchors(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    """Map side: later places of a context are covered; one anchor of each rank goes on to meet the other tasks'."""
    lead, later = _firsts(rows)
    same = _same(lead, "g")
    several = np.append(same[1:], False) & ~same
    lead["f"][several] = 1
    rep, rest = lead[~same], lead[same]
    return _frames(_dealt("anchor", rep, rep["g"], buckets), _dealt("context", rest, _joined_key(rest), buckets),
                   _spans(later, buckets))


def _meet_ranks(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    """All tasks' anchors of a rank: unique ones end, one shared context is settled, several contexts go on."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["x"], rows["g"]))]
    same = _same(rows, "g")
    group = np.cumsum(~same) - 1
    many = np.zeros(group[-1] + 1 if len(rows) else 0, bool)
    np.logical_or.at(many, group, (rows["f"] > 0) | (same & ~_same(rows, "g", "x")))
    go = many[group] if len(rows) else np.zeros(0, bool)
    _, later = _firsts(rows[~go])
    return _frames(_dealt("context", rows[go], _joined_key(rows[go]), buckets), _spans(later, buckets))


def _meet_contexts(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    lead, later = _firsts(rows)
    return _frames(_dealt("look", lead, lead["doc"], buckets), _spans(later, buckets))


def _settle_windows(rows: np.ndarray, buckets: int) -> pd.DataFrame:
    lead, later = _firsts(rows)
    return _frames(_dealt("window", lead, lead["g"], buckets), _spans(later, buckets))


def _by_kind(steps: dict):
    """Group function: applies a step to its kind's rows, hands the other kinds on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].iloc[0]
        if kind not in steps:
            return pdf
        return steps[kind](_unpack(KINDS[kind], pdf["data"]))
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("k"),
                       text.cast("binary").alias("body"))


def _first_pass(keyed: DataFrame, buckets: int) -> DataFrame:
    """Packed 'look' and 'span' records after the anchors have met."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out():
            pdf = _settle_anchors(np.concatenate(held), buckets)
            return pa.RecordBatch.from_pandas(pdf, schema=pa.schema(
                [("kind", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())]), preserve_index=False)

        for b in batches:
            docs, ks = (b.column(i).to_numpy() for i in (0, 1))
            bodies = [x.as_py() for x in b.column(2)]
            for found in text_anchors(bodies):
                which = found["doc"].copy()
                found["doc"], found["k"] = docs[which], ks[which]
                held.append(found)
                rows += len(found)
            if rows >= FLUSH_ROWS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return (keyed.where(F.octet_length("body") >= LENGTH).select("doc", "k", "body").mapInArrow(read, PACKED)
            .groupBy("kind", "bucket").applyInPandas(_by_kind({"anchor": lambda r: _meet_ranks(r, buckets)}), PACKED)
            .groupBy("kind", "bucket").applyInPandas(_by_kind({"context": lambda r: _meet_contexts(r, buckets)}), PACKED))


def _per_document(records: DataFrame, kind: str) -> DataFrame:
    """(doc, k, data): one record per document: merged spans, or the runs to look at."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _unpack(KINDS[kind], pdf["data"])
        rows = merged(rows) if kind == "span" else rows[np.lexsort((rows["lo"], rows["k"], rows["doc"]))]
        first = np.flatnonzero(~_same(rows, "doc", "k"))
        parts = np.split(rows, first[1:]) if len(first) else []
        cols = ("lo", "hi") if kind == "span" else ("lo", "n")
        return pd.DataFrame({"doc": rows["doc"][first], "k": rows["k"][first].astype(np.int64),
                             "data": [np.stack([p[c].astype("<u4") for c in cols]).tobytes() for p in parts]})

    return (records.where(F.col("kind") == kind).groupBy("bucket")
            .applyInPandas(run, "doc bigint, k bigint, data binary"))


def _beside(keyed: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``keyed`` with each document's record; the records are broadcast only below SIDE_BYTES."""
    side = stored(side)
    weight = side.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    return keyed.join(F.broadcast(side) if weight <= SIDE_BYTES else side, ["doc", "k"], how)


def _second_pass(keyed: DataFrame, look: DataFrame, buckets: int) -> DataFrame:
    """Packed 'span' records of single windows of the anchors to look at."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out():
            pdf = _settle_windows(np.concatenate(held), buckets)
            return pa.RecordBatch.from_pandas(pdf, schema=pa.schema(
                [("kind", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())]), preserve_index=False)

        for b in batches:
            for doc, k, body, data in zip(*(c.to_pylist() for c in b.columns)):
                lo, n = np.frombuffer(data, "<u4").reshape(2, -1).astype(np.int64)
                n = n + 1
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                view = _words(np.frombuffer(body, np.uint8))
                r = np.empty(len(at), NAMED)
                r["g"], r["x"] = _name(view, at, LENGTH, 0), _name(view, at, LENGTH, 2)
                r["doc"], r["k"], r["lo"] = doc, k, at
                held.append(r)
                rows += len(r)
                if rows >= FLUSH_ROWS:
                    yield out()
                    held, rows = [], 0
        if rows:
            yield out()

    def last(rows):
        return _spans(_firsts(rows)[1], buckets)

    return (_beside(keyed.select("doc", "k", "body"), look, "inner").select("doc", "k", "body", "data")
            .mapInArrow(read, PACKED)
            .groupBy("kind", "bucket").applyInPandas(_by_kind({"window": last}), PACKED))


def covered(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``docs`` (doc_id, doc, k, body) with ``data``: the removed spans (starts, then ends, as 32-bit numbers) or null."""
    keyed = _keyed(docs)
    if buckets is None:
        total = keyed.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
        buckets = max(8, -(-total // BUCKET_BYTES))
    first = stored(_first_pass(keyed, buckets))
    second = stored(_second_pass(keyed, _per_document(first, "look"), buckets))
    spans = _per_document(first.where("kind = 'span'").union(second.where("kind = 'span'")), "span")
    return _beside(keyed, spans, "left")


def digest(docs: DataFrame, buckets: int | None = None, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text);
    with ``kept`` also the remaining bytes."""
    src = covered(docs, buckets).select("doc_id", "body", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, spans, sums, left = [], [], [], [], []
            for body, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts, at, cut = [], 0, 0
                lo, hi = np.frombuffer(data or b"", "<u4").reshape(2, -1).tolist()
                for s, e in zip(lo, hi):
                    parts.append(body[at:s])
                    at, cut = e, cut + e - s
                parts.append(body[at:])
                rest = b"".join(parts)
                sizes.append(len(body))
                gone.append(cut)
                spans.append(len(lo))
                sums.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (sizes, gone, spans)), pa.array(sums, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if kept:
                cols.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                          + ", kept binary" * kept)
