"""A stored postings index for exact BM25 top-k.

The chunks are cut where they lie into slices of at most ``SLICE_CHUNKS``
chunks and ``SLICE_BYTES`` of text; inside a slice a chunk is known by its
position in id order. ``build`` writes two tables: ``chunks`` (slice, pos, id)
and ``postings``, (term, slice) with the positions, frequencies and chunk
lengths of the term there (``entries``, records of the narrowest integers that
hold them), in rows of at most ``ROW_POSTINGS``, and ``bound``, the largest
weight (without idf) that the term reaches in the row. Postings are laid out in term order, so a scan for some terms skips the row groups of
others. A task makes the postings of one slice at a time and a reader's batch
holds rows of bounded size: neither grows with the collection.

``search`` first reads (term, slice, n, bound) alone. The sum of idf * bound
over a query's terms limits the score of every chunk of a slice. The few
slices with the highest limit are scored first; their k-th score is a floor
of the final k-th score, and only slices whose limit reaches that floor are
scored after them: exact, with the postings of the query's own terms only.
Scoring is one cogroup of a slice's posting rows with a block of queries, as a
(query, chunk) matrix of bounded size; k rows per query and slice come out.

Defined results: the same rows as ``retrieval.text_top_k``. Null texts have no
token; ids are unique (see ``retrieval.index_upsert``), rows that share one
are ranked each. Raises when there is no chunk. Queries are the stated set;
repeated rows of one query count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.functions.text import token_text, tokens
from ledgerline.operators.partitioning import top_k_per_group
from ledgerline.operators.retrieval import BM25_B, BM25_K1, TOP_K
from ledgerline.session import checkpoint_dir

SLICE_CHUNKS = 4096
SLICE_BYTES = 16 << 20    # of token text
ROW_POSTINGS = 256        # a reader holds batches of some thousand rows
ROW_GROUP_BYTES = 16 << 20
BROADCAST_KEYS = 200_000  # hashes of 8 bytes
PART_TOKENS = 2_000_000   # of a part of the postings, whatever the shuffle settings
MAX_PARTS = 4096          # beyond them the parts grow, their sort spills
FIRST_SLICES = 2          # slices of a query that are scored to find its floor
QUERY_BLOCK = 512         # queries of one cogroup, on average
SCORE_CELLS = 2_000_000   # cells of a score matrix
SLACK = 1e-9              # relative; limits are summed in another order than scores


@dataclass(frozen=True)
class TextIndex:
    path: str
    chunks: int
    mean_length: float
    entry: np.dtype           # of a posting: pos, tf, dl

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of the slices of a task's (part, id, words) rows."""
    held, chunks, size, number = [], 0, 0, 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = min(lo + most - chunks, int(np.searchsorted(ends, before + SLICE_BYTES - size, "right")))
            hi = max(hi, lo if held else lo + 1)        # a chunk of any length is taken
            if hi > lo:
                held.append(b.slice(lo, hi - lo))
                chunks, size, lo = chunks + hi - lo, size + int(ends[hi - 1] - before), hi
            if lo < b.num_rows or chunks == most:
                yield number, pa.Table.from_batches(held)
                held, chunks, size, number = [], 0, 0, number + 1
    if held:
        yield number, pa.Table.from_batches(held)


def _poster(mean: float, most: int, record: np.dtype, schema: pa.Schema):
    """Function of (part, id, words) batches: the posting rows of each slice, and one row without term for its ids in order."""

    def post(number: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending")], null_placement="at_start"))
        slice_ = (rows["part"][0].as_py() << 32) + number
        words, n = rows["words"].combine_chunks(), rows.num_rows
        split = pc.split_pattern(words, " ")
        dl = np.where(pc.equal(words, "").to_numpy(zero_copy_only=False), 0, split.value_lengths().to_numpy(zero_copy_only=False))
        token = split.flatten()
        coded = token.filter(pc.not_equal(token, "")).dictionary_encode()
        # one entry per (term, chunk), terms in the order of their codes
        entry, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), dl), return_counts=True)
        term, pos = np.divmod(entry, n)
        weight = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[pos] / mean))
        ends = np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))
        starts = np.concatenate([[0], ends[:-1]]).astype(int)[:len(ends)]
        pieces = -(-(ends - starts) // ROW_POSTINGS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cuts = np.append(np.repeat(starts, pieces) + piece * ROW_POSTINGS, len(entry))
        entries = np.empty(len(entry), record)
        entries["pos"], entries["tf"], entries["dl"] = pos, tf, dl[pos]
        ends = pa.py_buffer((cuts * record.itemsize).astype(np.int32))
        code = np.repeat(np.arange(len(pieces)), pieces)
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows["id"].combine_chunks())
        if len(code):
            columns = [coded.dictionary.take(pa.array(code)), pa.array(np.full(len(code), slice_)), pa.array(np.diff(cuts)),
                       pa.array(np.maximum.reduceat(weight, cuts[:-1])), pa.Array.from_buffers(pa.binary(), len(code), [None, ends, pa.py_buffer(entries)]),
                       pa.nulls(len(code), schema.field("ids").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([slice_], f.type) if f.name == "slice" else ids.cast(f.type) if f.name == "ids"
                                          else pa.nulls(1, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _slices(batches, most):
            yield from post(number, rows)
    return run


def build(chunks: DataFrame, path: str, chunk_id: str = "id", text_col: str = "text",
          slice_chunks: int = SLICE_CHUNKS) -> TextIndex:
    """Write the index of ``chunks`` to the new folder ``path``. Texts are not shuffled, the postings once."""
    spark = chunks.sparkSession
    checkpoint_dir(spark)
    # tokens hold no space: as one string they take a third of the bytes of a list
    words = F.coalesce(token_text(F.col(text_col)), F.lit(""))
    base = chunks.select(F.col(chunk_id).alias("id"), words.alias("words")).checkpoint()
    spaces = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit("")))
    length = F.when(F.col("words") == "", 0).otherwise(spaces + 1)
    n, mean, longest = base.select(length.alias("dl")).agg(F.count(F.lit(1)), F.avg("dl"), F.max("dl")).first()
    if not n:
        raise RuntimeError("no chunk in the collection")
    record = np.dtype([("pos", np.min_scalar_type(slice_chunks)), *[(c, np.min_scalar_type(longest)) for c in ("tf", "dl")]])
    # a checkpoint's parts are the same for every attempt of a task, so a slice is known by its part and place there;
    # parts of less than a slice are put together
    parts = base.coalesce(max(1, n // slice_chunks)).select(F.spark_partition_id().alias("part"), "id", "words")
    schema = base.select(F.lit("").alias("term"), F.lit(0).cast("long").alias("slice"), F.lit(0).alias("n"), F.lit(0.0).alias("bound"),
                         F.lit(b"").alias("entries"), F.array("id").alias("ids")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    # the ranges are sampled first: without a checkpoint all of the above would run twice
    made = parts.mapInArrow(_poster(mean, slice_chunks, record, to_arrow_schema(schema)), schema).checkpoint()
    made.where("term IS NULL").select("slice", F.posexplode("ids").alias("pos", "id")).write.parquet(f"{path}/chunks")
    ranges = min(MAX_PARTS, int(n * mean) // PART_TOKENS + 1)
    (made.where("term IS NOT NULL").drop("ids").repartitionByRange(ranges, "term", "slice").sortWithinPartitions("term", "slice")
     .write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/postings"))
    return TextIndex(path, n, mean, record)


def _scorer(mean: float, record: np.dtype, k: int, schema: pa.Schema):
    """Cogroup function: (query_id, terms, idfs) rows and posting rows of one slice -> its k best chunks per query."""
    none = schema.empty_table()

    def score(wanted: pa.Table, postings: pa.Table) -> pa.Table:
        if not wanted.num_rows or not postings.num_rows:
            return none
        postings = postings.sort_by("term")
        entries = np.frombuffer(b"".join(postings["entries"].to_pylist()), record)
        pos, tf, dl = (entries[c].astype(np.int64) for c in ("pos", "tf", "dl"))
        terms = postings["term"].combine_chunks().dictionary_encode()
        # a term's rows stand side by side
        ends = np.cumsum(np.bincount(terms.indices.to_numpy(), postings["n"].to_numpy())).astype(int)
        starts = np.concatenate([[0], ends[:-1]])
        part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / mean))
        coded, asked = wanted["query_id"].combine_chunks().dictionary_encode(), wanted["terms"].combine_chunks()
        query = np.repeat(coded.indices.to_numpy(), asked.value_lengths().to_numpy())
        term = pc.index_in(asked.flatten(), terms.dictionary).fill_null(-1).to_numpy()
        row = np.flatnonzero(term >= 0)
        row = row[np.lexsort((term[row], query[row]))]     # a score is summed in term order
        query, term, idf = query[row], term[row], wanted["idfs"].combine_chunks().flatten().to_numpy()[row]
        size, width = ends[term] - starts[term], int(pos.max()) + 1
        cost = np.maximum(np.bincount(query, size, len(coded.dictionary)), width)
        step = (np.cumsum(cost) // SCORE_CELLS).astype(int)[query]
        found = []
        for s in np.unique(step):
            at = np.flatnonzero(step == s)
            lo, hi = query[at[0]], query[at[-1]] + 1
            n = size[at]
            entry = np.repeat(starts[term[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = np.repeat((query[at] - lo) * width, n) + pos[entry]
            scores = np.bincount(key, np.repeat(idf[at], n) * part[entry], (hi - lo) * width).reshape(hi - lo, width)
            floor = np.partition(scores, -k, axis=1)[:, -k, None] if width > k else 0.0
            q, p = np.nonzero((scores > 0) & (scores >= floor))
            order = np.lexsort((p, -scores[q, p], q))
            q, p = q[order], p[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((q[best] + lo, p[best], scores[q[best], p[best]]))
        q, p, x = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        slice_ = pa.array(np.full(len(q), wanted["slice"][0].as_py()), pa.int64())
        return pa.Table.from_arrays([coded.dictionary.take(pa.array(q, pa.int64())).cast(schema.field(0).type), slice_,
                                     pa.array(p, pa.int32()), pa.array(x, pa.float64())], schema=schema)
    return score


def _plan(queries: DataFrame, index: TextIndex, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """((query_id, term, idf), (query_id, slice, ceiling)) of the queries."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).distinct().checkpoint()
    heads = _among(index.table(spark, "postings").select("term", "slice", "n", "bound"), q, "term")
    heads = (heads.join(q.select("term").distinct(), "term", "left_semi")
             .groupBy("term", "slice").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")).checkpoint())
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    weights = df.select("term", F.log(1 + (index.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    wanted = q.join(weights, "term").select("query_id", "term", "idf").checkpoint()
    limits = wanted.join(heads, "term").groupBy("query_id", "slice").agg(F.sum(F.col("idf") * F.col("bound")).alias("ceiling"))
    return wanted, limits.checkpoint()


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key's hash is among those of the keys, before any shuffle; all rows if there are too many keys to broadcast."""
    few = keys.select(F.xxhash64(key).alias("_key")).distinct()
    if few.count() > BROADCAST_KEYS:
        return rows
    return rows.join(F.broadcast(few), F.xxhash64(key) == F.col("_key"), "left_semi")


def _scored(wanted: DataFrame, pairs: DataFrame, index: TextIndex, k: int, blocks: int) -> DataFrame:
    """(query_id, slice, pos, score) for the given (query_id, slice) pairs."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    of_query = wanted.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("w"))
    asked = pairs.select("query_id", "slice").join(of_query, "query_id").select(
        "slice", block, "query_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"))
    needed = asked.select(*[F.col(c).alias(c) for c in ("slice", "block")], F.explode("terms").alias("term")).distinct()   # columns of their own: both sides meet again
    rows = _among(_among(index.table(wanted.sparkSession, "postings"), wanted, "term"), pairs, "slice")
    rows = rows.join(needed, ["slice", "term"]).select("slice", "block", "term", "n", "entries")
    schema = wanted.select("query_id", F.lit(0).cast("long").alias("slice"), F.lit(0).alias("pos"), F.lit(0.0).alias("score")).schema
    return (asked.groupBy("slice", "block").cogroup(rows.groupBy("slice", "block"))
            .applyInArrow(_scorer(index.mean_length, index.entry, k, to_arrow_schema(schema)), schema))


def _search(queries: DataFrame, index: TextIndex, k: int, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((query_id, slice, pos, score) found, (query_id, term, idf), (query_id, slice) pairs scored)."""
    wanted, limits = _plan(queries, index, query_id, query_text)
    blocks = max(1, wanted.select("query_id").distinct().count() // QUERY_BLOCK)
    first = top_k_per_group(limits, "query_id", [F.col("ceiling").desc(), F.col("slice")], FIRST_SLICES).select("query_id", "slice").checkpoint()
    early = _scored(wanted, first, index, k, blocks).checkpoint()
    floors = (top_k_per_group(early, "query_id", [F.col("score").desc(), F.col("slice"), F.col("pos")], k)
              .where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
    rest = (limits.join(first, ["query_id", "slice"], "left_anti").join(floors, "query_id", "left")
            .where(F.col("floor").isNull() | (F.col("ceiling") * (1 + SLACK) >= F.col("floor"))).select("query_id", "slice").checkpoint())
    return early.unionByName(_scored(wanted, rest, index, k, blocks)), wanted, first.unionByName(rest)


def search(queries: DataFrame, index: TextIndex, k: int = TOP_K, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, id): the ``k`` best chunks per query by BM25; ties by id."""
    found, _, _ = _search(queries, index, k, query_id, query_text)
    # positions follow ids inside a slice only, so all chunks that tie with the k-th meet their ids before the last cut
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    found = found.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= k).drop("rank")
    named = found.join(index.table(queries.sparkSession, "chunks"), ["slice", "pos"])
    return top_k_per_group(named, "query_id", [F.col("score").desc(), F.col("id")], k).select("query_id", "rank", "id")


def work(queries: DataFrame, index: TextIndex, k: int = TOP_K, query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(all_postings, term_postings, read_postings): postings stored, of the queries' terms, and of the rows that ``search`` scores."""
    spark = queries.sparkSession
    _, wanted, pairs = _search(queries, index, k, query_id, query_text)
    heads = index.table(spark, "postings").select("term", "slice", "n")
    own = heads.join(wanted.select("term").distinct(), "term", "left_semi")
    read = heads.join(pairs.join(wanted, "query_id").select("term", "slice").distinct(), ["term", "slice"], "left_semi")
    return spark.range(1).select(*[F.coalesce(d.agg(F.sum("n")).scalar(), F.lit(0)).alias(c)
                                   for c, d in [("all_postings", heads), ("term_postings", own), ("read_postings", read)]])
