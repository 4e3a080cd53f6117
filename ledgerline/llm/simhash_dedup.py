"""SimHash near-duplicates: a self-join of a binary trie of fingerprints.

1. Every text gets a 64-bit fingerprint (word shingles, XXH64 with seed 42,
   majority per bit), computed in Arrow batches where the text is read.
2. Equal fingerprints collapse to one row before anything else (map-side
   combining), so exact copies never meet in one task.
3. The trie over the distinct fingerprints is cut into subtries of bounded
   size (its frontier): prefix counts are aggregated in Spark, and a prefix
   that holds too many fingerprints is refined to longer prefixes.
4. Pairs of frontier nodes are traversed together: each bit where two
   prefixes differ uses up one unit of the error budget, and a pair beyond
   the budget is pruned. Each surviving pair of subtries becomes one task,
   which goes on with the same traversal down to the leaves.
5. A task emits a spanning forest of its links (at most one row per
   fingerprint), never all pairs of a group; components of the links are
   found in Spark (``components``).

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other. A null doc_id takes part in links but is never a
component id unless the whole component has none. Repeated rows keep one
result row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import collapse_repeats, fresh, row_columns, row_key, stored
from ledgerline.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42

# Frontier: a subtrie has at most max(MIN_SUBTRIE, n / MAX_SUBTRIES) fingerprints.
MIN_SUBTRIE = 4096
MAX_SUBTRIES = 4096
FIRST_PREFIX = 16
PREFIX_STEP = 8
# Node pairs handled at once inside a task, and the largest leaf product compared directly.
PAIR_CHUNK = 200_000
LEAF_PRODUCT = 32
BIT_ROWS = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one UTF-8 text (see the module text)."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    body = b" ".join(found)
    if len(found) <= shingle:
        return xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    hashes = np.array([xxh64_intdigest(body[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())],
                      dtype=np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BIT_ROWS):
        octets = hashes[i:i + BIT_ROWS].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view(np.uint64)[0])


def with_fingerprint(df: DataFrame, keep: list[Column], text: Column, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long) of each row."""
    src = df.select(*keep, text.cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(b.num_columns - 1)], dtype=np.uint64)
            cols = [*b.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "fp"])

    return src.mapInArrow(run, schema)


def _frontier(prints: DataFrame, n: int, min_subtrie: int) -> list[tuple[int, int]]:
    """Subtries (prefix, depth) in order, each with at most the bounded number of fingerprints.

    Only counts of prefixes reach the driver: 2^16 at most, and 2^8 for each
    prefix that is refined, of which there are at most MAX_SUBTRIES.
    """
    cap = max(min_subtrie, n // MAX_SUBTRIES)
    out: list[tuple[int, int]] = []

    def descend(prefix: int, depth: int, counts: dict[int, int], bottom: int) -> list[int]:
        """Subtries below one prefix whose counts are known at depth ``bottom``; returns the heavy ones."""
        heavy, levels = [], {bottom: counts}
        for d in range(bottom - 1, depth - 1, -1):
            up: dict[int, int] = {}
            for p, c in levels[d + 1].items():
                up[p >> 1] = up.get(p >> 1, 0) + c
            levels[d] = up
        stack = [(prefix, depth)]
        while stack:
            p, d = stack.pop()
            c = levels[d].get(p, 0)
            if not c:
                continue
            if c <= cap or d == 64:
                out.append((p, d))
            elif d == bottom:
                heavy.append(p)
            else:
                stack += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        return heavy

    def counted(depth: int, below: list[int] | None) -> dict[int, int]:
        p = F.shiftrightunsigned("fp", 64 - depth).alias("p") if depth < 64 else F.col("fp").alias("p")
        src = prints
        if below is not None:
            up = prints.sparkSession.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in below], "q bigint")
            src = prints.join(F.broadcast(up), F.shiftrightunsigned("fp", 64 - depth + PREFIX_STEP) == F.col("q"))
        return {r["p"] % (1 << 64): r["count"] for r in src.groupBy(p).count().collect()}

    depth = FIRST_PREFIX
    heavy = descend(0, 0, counted(depth, None), depth)
    while heavy:
        below, heavy, depth = heavy, [], depth + PREFIX_STEP
        counts = counted(depth, below)
        for q in below:
            own = {p: c for p, c in counts.items() if p >> PREFIX_STEP == q}
            heavy += descend(q, depth - PREFIX_STEP, own, depth)
    return sorted(out, key=lambda x: x[0] << (64 - x[1]))


def _frontier_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Index pairs (i <= j) of subtries that may hold fingerprints within ``budget`` bits.

    Both nodes of a pair descend together; a node that is a frontier leaf
    stays while the other one descends below it.
    """
    where = {(d, p): i for i, (p, d) in enumerate(nodes)}
    inner = {(d - k, p >> k) for p, d in nodes for k in range(1, d + 1)}
    pairs, stack = set(), [((0, 0), (0, 0), 0)] if nodes else []
    while stack:
        a, b, err = stack.pop()
        if a in where and b in where:
            pairs.add((min(where[a], where[b]), max(where[a], where[b])))
            continue
        kids = []
        for x in (a, b):
            kids.append([x] if x in where else [(x[0] + 1, 2 * x[1] + k) for k in (0, 1)
                                                if (x[0] + 1, 2 * x[1] + k) in where or (x[0] + 1, 2 * x[1] + k) in inner])
        for i, x in enumerate(kids[0]):
            for j, y in enumerate(kids[1]):
                if a == b and j < i:
                    continue
                # a fresh bit on both sides is compared; a leaf above the other node has none here
                d = min(x[0], y[0])
                e = ((x[1] >> (x[0] - d)) ^ (y[1] >> (y[0] - d))).bit_count()
                if e <= budget:
                    stack.append((x, y, e))
    return sorted(pairs)


def _compress(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union of the links u-v in a flat forest (label of a root is itself)."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        label = _compress(label)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated ranges lo[i] .. lo[i] + n[i] - 1."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - lo, n)


def trie_links(values: np.ndarray, left: int, budget: int) -> np.ndarray:
    """Labels of a spanning forest of the links between two sorted subtries.

    ``values[:left]`` and ``values[left:]`` are the sorted fingerprints of the
    two subtries; with ``left == len(values)`` the subtrie is joined with
    itself. A node is a range of the sorted array; node pairs descend one bit
    at a time, adding differing bits, and small pairs are compared directly.
    """
    n = len(values)
    label = np.arange(n)
    own = left == n
    a0, b0 = (0, n), ((0, n) if own else (left, n))
    stack = [(0, np.array([[a0[0], a0[1], b0[0], b0[1], 0]], np.int64))]
    while stack:
        depth, p = stack.pop()
        if len(p) > PAIR_CHUNK:
            half = len(p) // 2
            stack += [(depth, p[half:]), (depth, p[:half])]
            continue
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        small = (na * nb <= LEAF_PRODUCT) | (depth == 64)
        if small.any():
            q, ka, kb = p[small], na[small], nb[small]
            i = np.repeat(_ranges(q[:, 0], ka), np.repeat(kb, ka))
            j = _ranges(np.repeat(q[:, 2], ka), np.repeat(kb, ka))
            hit = np.bitwise_count(values[i] ^ values[j]) <= budget
            hit &= i != j
            label = _merge(label, i[hit], j[hit])
            p = p[~small]
        if not len(p):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)

        def split(lo, hi, first, last):
            """First index of each range whose bit is set (ranges are sorted)."""
            low = values[lo] & ~(bit | (bit - np.uint64(1)))
            found = first + np.searchsorted(values[first:last], low | bit)
            return np.minimum(np.maximum(found, lo), hi)

        am = split(p[:, 0], p[:, 1], a0[0], a0[1])
        bm = split(p[:, 2], p[:, 3], b0[0], b0[1])
        same = own & (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        e = p[:, 4]
        kids = [np.stack((p[:, 0], am, p[:, 2], bm, e), 1), np.stack((am, p[:, 1], bm, p[:, 3], e), 1),
                np.stack((p[:, 0], am, bm, p[:, 3], e + 1), 1),
                np.stack((am, p[:, 1], p[:, 2], bm, e + 1), 1)[~same]]
        p = np.concatenate(kids)
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2]) & (p[:, 4] <= budget)]
        if len(p):
            stack.append((depth + 1, p))
    return label


def _links(prints: DataFrame, budget: int, min_subtrie: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within ``budget`` bits."""
    spark = prints.sparkSession
    n = prints.count()
    nodes = _frontier(prints, n, min_subtrie)
    pairs = _frontier_pairs(nodes, budget)
    if not pairs:
        return spark.createDataFrame([], "a bigint, b bigint")
    starts = np.array([p << (64 - d) for p, d in nodes], dtype=np.uint64)
    uses: list[list[tuple[int, int]]] = [[] for _ in nodes]
    for k, (i, j) in enumerate(pairs):
        uses[i].append((k, 0))
        if j != i:
            uses[j].append((k, 1))
    shared = spark.sparkContext.broadcast((starts, uses))

    def placed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            node = np.searchsorted(shared.value[0], fp.view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(node.astype(np.int32))], names=["fp", "node"])

    def subtrie(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64)).tobytes()
        own = shared.value[1][int(pdf["node"].iloc[0])]
        return pd.DataFrame({"pair": [k for k, _ in own], "side": [s for _, s in own], "prints": [blob] * len(own)})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        sides = [np.frombuffer(x, np.uint64) for x in pdf["prints"]]
        values = np.concatenate(sides)
        label = trie_links(values, len(sides[0]), budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[label[moved]].view(np.int64)})

    return (prints.select("fp").mapInArrow(placed, "fp bigint, node int")
            .groupBy("node").applyInPandas(subtrie, "pair int, side int, prints binary")
            .groupBy("pair").applyInPandas(joined, "a bigint, b bigint"))


def classes(light: DataFrame, budget: int = MAX_DISTANCE, min_subtrie: int = MIN_SUBTRIE) -> DataFrame:
    """(fp, first): for each distinct fingerprint of ``light`` (fp, id) the smallest id of its component."""
    prints = stored(light.groupBy("fp").agg(F.min("id").alias("id")))
    linked = components(_links(prints, budget, min_subtrie), "a", "b")
    rooted = (prints.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "id", F.coalesce("root", "fp").alias("root")))
    first = rooted.groupBy("root").agg(F.min("id").alias("first"))
    return stored(rooted.join(first, "root").select("fp", "first"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE,
                    min_subtrie: int = MIN_SUBTRIE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    light = stored(with_fingerprint(docs, [F.col("doc_id").alias("id")], F.col("text"), shingle))
    found = classes(light, budget, min_subtrie)
    return light.join(found, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE_WORDS, budget: int = MAX_DISTANCE,
             min_subtrie: int = MIN_SUBTRIE) -> DataFrame:
    """The rows of ``docs`` with one row left of each component: the smallest doc_id (null last,
    ties by a hash of the row). All columns are kept; repeated rows count as one."""
    a, b, n = fresh(docs, "_k", 3)
    once = collapse_repeats(docs, n)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ka, kb = row_key(row_columns(docs))
    once = once.withColumns({a: ka, b: kb})
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"),
                   F.col(a).alias("a"), F.col(b).alias("b"))
    light = stored(with_fingerprint(once, [key.alias("id")], F.col("text"), shingle))
    found = classes(light, budget, min_subtrie).select("first.*")
    keep = found.select(F.col("a").alias(a), F.col("b").alias(b)).distinct()
    return once.join(keep, [a, b], "left_semi").select(*columns)


