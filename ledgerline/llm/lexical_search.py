"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to OWNERS owners by their document frequency,
the rarest first. Documents stand in slices of bounded size. A bundle is what
is known of one item in one slice: a sparse accumulator (documents, scores).
All bundles travel through the owners in turn: at each stage they are
cogrouped by slice with the postings of the owner's terms, every posting adds
its integer contribution to the accumulators of the items that hold the term,
and the bundles move on. After the last owner a slice hands on its k best
documents per item, from which the k best of all follow.

A bundle drops a document that can no longer be among the k best of its own
slice: contributions are never negative and a term adds at most
FULL * weight, so a score plus the most that later owners can add, if below
the k-th best score of now, stays below k documents of the slice. This is
exact and is what keeps bundles small: the terms that stand in most documents
come last.

Postings are built in the pass that reads the texts, as one row per (slice,
term), for the items' terms only while these are few enough for a broadcast
(TERM_BYTES); else all terms are written and a join picks them. A slice has
at most SLICE_DOCS documents and about SLICE_TERMS terms, items come in
blocks of about ITEM_BLOCK, so a cogroup's group is bounded however often a
term or a document repeats.

Defined results: a null or termless text is no document and no item of a
result. Every row of the two tables is a document or an item of its own, so
repeated items get repeated results. A null doc_id follows all others in
ties. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored
from ledgerline.llm.term_bytes import LOWERED, TERM_PATTERN, UPPER, Numbered, Wanted, term_lists
from ledgerline.operators.partitioning import top_k_per_group

TOP = 20
OWNERS = 4             # owner i < OWNERS - 1 holds the terms of at most N / 10 ** (OWNERS - 1 - i) documents
SLICE_DOCS = 4096
SLICE_TERMS = 4_000_000
ITEM_BLOCK = 512
TERM_BYTES = 32 << 20
FULL = 1_000_000       # no contribution reaches this share of a weight
B_PERCENT = 25
LAST = (1 << 63) - 1

INDEX = "slice long, term binary, places array<int>, counts array<int>, ids array<long>"
# item -1: the slice's documents (their length norms in ``scores``, their ids)
BUNDLE = "slice long, block int, item long, places array<int>, scores array<long>, ids array<long>"
FOUND = "item long, doc long, score long"


# ---- index ------------------------------------------------------------------------

class Slice:
    """Documents of one slice and the uses of their terms."""

    def __init__(self, wanted: dict | None):
        self.terms = Numbered() if wanted is None else wanted
        self.fixed = wanted is not None
        self.ids, self.sizes, self.uses, self.held = [], [], [], 0

    def add(self, doc: int, text: str):
        size = 0
        for terms in term_lists(text):
            uses = np.fromiter(map(self.terms.__getitem__, terms), np.int64, len(terms))
            size += len(uses)
            uses = uses[uses >= 0]
            cell, n = np.unique(uses, return_counts=True)
            self.uses.append((np.full(len(cell), len(self.ids)), cell, n))
            self.held += len(cell)
        self.ids.append(doc)
        self.sizes.append(size)

    def full(self) -> bool:
        return len(self.ids) >= SLICE_DOCS or self.held >= SLICE_TERMS

    def batch(self, number: int) -> pa.RecordBatch:
        """A first row with the documents' ids and sizes (null term), then a row per term."""
        place, term, n = (np.concatenate(c) for c in zip(*self.uses)) if self.uses else (np.empty(0, np.int64),) * 3
        # parts of one long text count together
        cell, back = np.unique(term * SLICE_DOCS + place, return_inverse=True)
        n = np.bincount(back, n, len(cell)).astype(np.int32)
        term, place = cell // SLICE_DOCS, (cell % SLICE_DOCS).astype(np.int32)
        held, first = np.unique(term, return_index=True)
        names = list(self.terms)
        k = len(self.ids)
        offsets = np.concatenate([[0], k + first, [k + len(cell)]]).astype(np.int32)
        places = np.concatenate([np.arange(k, dtype=np.int32), place])
        counts = np.concatenate([np.array(self.sizes, np.int32), n])
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(len(held) + 1, k)]), pa.int32()), pa.array(self.ids, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held) + 1, number), pa.int64()), pa.array([None] + [names[t] for t in held], pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(places)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts)), ids],
            names=["slice", "term", "places", "counts", "ids"])


def index(docs: DataFrame, terms: list[bytes] | None) -> DataFrame:
    """Slices of ``docs`` (doc, text) as INDEX rows, written as a table (slices are numbered by the task that fills them)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared.value is None else Wanted((t, i) for i, t in enumerate(shared.value))
        number, here = TaskContext.get().partitionId() << 32, Slice(wanted)
        for batch in batches:
            for i in range(batch.num_rows):
                here.add(batch.column("doc")[i].as_py(), batch.column("text")[i].as_py())
                if here.full():
                    yield here.batch(number)
                    number, here = number + 1, Slice(wanted)
        if here.ids:
            yield here.batch(number)
    return stored(docs.mapInArrow(run, INDEX))


# ---- stages -----------------------------------------------------------------------

def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _stage(k: int, last: bool):
    """One owner's work on a group: its postings add to the bundles, which lose what cannot win and move on (``last``: the k best)."""
    def run(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        documents = bundles[bundles["item"] < 0].iloc[0]
        norm, ids = np.asarray(documents["scores"], np.int64), np.asarray(documents["ids"], np.int64)
        score = {}
        for item, places, scores in zip(bundles["item"], bundles["places"], bundles["scores"]):
            if item >= 0:
                score[item] = np.zeros(len(norm), np.int64)
                score[item][np.asarray(places, np.int64)] = scores
        left = {}
        for places, counts, weight, items, uses, later in zip(*(postings[c] for c in ("places", "counts", "weight", "items", "uses", "later"))):
            places, tf = np.asarray(places, np.int64), np.asarray(counts, np.int64)
            gain = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[places]))
            for item, n, most in zip(items, uses, later):
                if item not in score:
                    score[item] = np.zeros(len(norm), np.int64)
                score[item][places] += n * gain
                left[item] = most
        out = []
        for item, total in score.items():
            held = np.flatnonzero(total)
            if len(held) > k and (last or item in left):
                least = np.partition(total[held], -k)[-k] - (0 if last else left[item])
                held = held[total[held] >= least]
            if last:
                best = held[np.lexsort((ids[held], -total[held]))[:k]]
                out += [(item, ids[b], total[b]) for b in best]
            else:
                out.append((documents["slice"], documents["block"], item, held.astype(np.int32), total[held], []))
        if last:
            return pd.DataFrame(out, columns=_columns(FOUND))
        out.append(tuple(documents[c] for c in _columns(BUNDLE)))
        return pd.DataFrame(out, columns=_columns(BUNDLE))
    return run


def _terms(items: DataFrame) -> DataFrame:
    """(item, block, term, uses) of items (item, block, text)."""
    text = F.translate(F.col("text"), UPPER, LOWERED)
    return (items.select("item", "block", F.explode(F.regexp_extract_all(text, F.lit(TERM_PATTERN), 0)).alias("term"))
            .groupBy("item", "block", F.col("term").cast("binary").alias("term")).agg(F.count(F.lit(1)).alias("uses")))


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    terms = stored(_terms(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))))
    distinct = terms.select("term").distinct()
    size = distinct.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    wanted = sorted(bytes(r["term"]) for r in distinct.collect()) if size <= TERM_BYTES else None
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    table = index(rows, wanted)

    documents, postings = table.where("term IS NULL"), table.where("term IS NOT NULL").select("slice", "term", "places", "counts")
    n, length = documents.agg(F.sum(F.size(F.filter("counts", lambda x: x > 0))).cast("long"),
                              F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if wanted is None:
        postings = postings.join(distinct, "term", "left_semi")
    df = F.col("df")
    owner = sum((F.when(df * 10 ** (OWNERS - 1 - i) > F.lit(n or 0), 1).otherwise(0) for i in range(OWNERS - 1)), F.lit(0))
    weights = (postings.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
               .select("term", owner.alias("owner"), F.floor(1000 * F.log((2 * F.lit(n or 0) + 2) / (2 * df + 1).cast("double"))).alias("weight")))
    held = terms.join(weights, "term")
    most = F.col("uses") * F.col("weight") * FULL
    later = held.groupBy("item").agg(*[F.sum(F.when(F.col("owner") > i, most).otherwise(0)).alias(f"later{i}") for i in range(OWNERS)])
    user = F.struct("item", "uses", F.array(*[f"later{i}" for i in range(OWNERS)])[F.col("owner")].alias("later"))
    users = stored(held.join(later, "item").groupBy("block", "term", "owner", "weight").agg(F.collect_list(user).alias("users"))
                   .select("block", "term", "owner", "weight", *[F.col(f"users.{c}").alias(to) for c, to in
                                                                 (("item", "items"), ("uses", "uses"), ("later", "later"))]))
    norm = F.expr(f"transform(counts, n -> {100 - B_PERCENT}L + ({B_PERCENT}L * n * {n or 0}L) div {max(length or 0, 1)}L)")
    bundles = documents.select("slice", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).cast("long").alias("item"),
                               F.array().cast("array<int>").alias("places"), norm.alias("scores"), "ids")
    for i in range(OWNERS):
        last = i == OWNERS - 1
        mine = postings.join(users.where(F.col("owner") == i).drop("owner"), "term").select(
            F.col("slice").alias("slice"), "block", "places", "counts", "weight", "items", "uses", "later")
        bundles = (bundles.groupBy("slice", "block").cogroup(mine.groupBy("slice", "block"))
                   .applyInPandas(_stage(k, last), FOUND if last else BUNDLE))
    ranked = top_k_per_group(bundles, "item", [F.col("score").desc(), F.col("doc")], k)
    return (ranked.join(items.select("item", "item_id"), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "score"))
