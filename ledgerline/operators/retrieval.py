"""Document chunking, chunk index upsert and top-k retrieval.

Chunking is a pure column expression (``sequence`` of window starts +
``posexplode`` + ``substring``): one row in, its chunks out, no shuffle.

Vector retrieval is exact: the queries are cut into blocks of bounded bytes,
each block is broadcast, and every batch of vectors is compared with it as a
matrix (Arrow batches); a task hands on its k nearest per query, so what is
shuffled is k rows per query and task, never all pairs.

Text retrieval scores with Okapi BM25 (our choice: the reference's embedder
is a model that is not part of it). The tokenised chunks are materialised
once; batches of them are scored against blocks of queries as matrices, and
only the k best per query and batch reach the top-k window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.functions.text import file_stem, normalize_whitespace, tokens
from ledgerline.operators.partitioning import number_within, top_k_per_group
from ledgerline.session import checkpoint_dir

# Chunk window and default number of retrieved chunks.
CHUNK_SIZE = 450
CHUNK_OVERLAP = 70
TOP_K = 3
# Pages of a bin when they are numbered: they carry their texts, and what follows runs where a bin's pages are.
PAGES_PER_BIN = 2_000
# BM25 parameters (the usual defaults).
BM25_K1 = 1.2
BM25_B = 0.75
# Query vectors compared at once: bytes of one broadcast block.
QUERY_BLOCK_BYTES = 16 << 20
# Cells of a distance matrix, and vectors compared at once.
DISTANCE_CELLS = 2_000_000
VECTOR_STEP = 2_000
# Text queries compared at once: (query, term) pairs of one broadcast block, and cells of a score matrix.
QUERY_BLOCK_TERMS = 200_000
SCORE_CELLS = 2_000_000


# ---- pages and chunks ----------------------------------------------------------

def page_text(docs: DataFrame, source_col: str = "source", order_col: str = "doc_id",
              text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(source, page, text): each row is one page of its source, numbered 1..n
    in ``order_col`` order. Blank pages (whitespace only) are skipped after
    numbering, as physical pages keep their numbers."""
    keep = keep or []
    numbered = number_within(docs.select(source_col, order_col, text_col, *keep), [source_col], [order_col], "page", PAGES_PER_BIN)
    return numbered.where(normalize_whitespace(F.col(text_col)) != "").select(
        F.col(source_col).alias("source"), F.col("page").cast("int").alias("page"),
        F.col(text_col).alias("text"), *keep)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when ``df`` has no row (one-row probe, not a count)."""
    if not df.limit(1).collect():
        raise RuntimeError(f"no {what}")
    return df


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """0-based window starts: 0, then k*(size-overlap) while < length-overlap."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - overlap - 1), F.lit(size - overlap))


def chunk_text(df: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Every input row with ``chunk`` (1-based) and ``chunk_text``.

    Whitespace is normalised first; an empty text gives no chunk. Windows of
    ``size`` characters overlap by ``overlap``; the last window ends the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be >= 0 and smaller than chunk size")
    # through a generator, so that the text is normalised once and not for each use
    norm = normalize_whitespace(F.col(text_col)).alias("_t")
    base = df.select("*", F.inline(F.array(F.struct(norm)))).where(F.length("_t") > 0)
    ex = base.select("*", F.posexplode(chunk_starts(F.length("_t"), size, overlap)).alias("_i", "_start"))
    return (ex.withColumn("chunk", (F.col("_i") + 1).cast("int"))
            .withColumn("chunk_text", F.substring(F.col("_t"), F.col("_start") + 1, size))
            .drop("_t", "_i", "_start"))


def chunk_records(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, source, page, chunk, text) with id ``{stem}_p{page}_c{chunk}``."""
    c = chunk_text(pages, "text", size, overlap)
    cid = F.concat(file_stem(F.col("source")), F.lit("_p"), F.col("page").cast("string"),
                   F.lit("_c"), F.col("chunk").cast("string"))
    return c.select(cid.alias("id"), "source", "page", "chunk", F.col("chunk_text").alias("text"))


# ---- vector retrieval ----------------------------------------------------------

def _distances(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(queries, vectors) distances, smaller is nearer. l2: squared Euclidean; cosine: 1 - cos; ip: -dot.

    Every entry is summed over the dimensions in order, so equal vectors get
    equal distances whatever batch they stand in.
    """
    out = np.zeros((len(queries), len(vectors)))
    if metric == "l2":
        for d in range(queries.shape[1]):
            diff = queries[:, d, None] - vectors[None, :, d]
            out += diff * diff
        return out
    for d in range(queries.shape[1]):
        out += queries[:, d, None] * vectors[None, :, d]
    if metric == "ip":
        return -out
    if metric == "cosine":
        def length(x):
            s = np.zeros(len(x))
            for d in range(x.shape[1]):
                s += x[:, d] * x[:, d]
            return np.sqrt(s)
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - out / (length(queries)[:, None] * length(vectors)[None, :])
    raise ValueError(f"unknown metric {metric}")


def _best(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of each row with the least distance, ties by id; ``ids`` and ``d`` are (queries, candidates)."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    ids, d = np.take_along_axis(ids, by_id, 1), np.take_along_axis(d, by_id, 1)
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)


def _k_nearest(metric: str, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector ids, distances), both (queries, k): the k nearest of a batch, ties by id. Matrices hold DISTANCE_CELLS at most."""
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    step = max(1, DISTANCE_CELLS // max(1, len(vid)))
    ids, distances = [], []
    for lo in range(0, max(1, len(q)), step):
        d = _distances(metric, q[lo:lo + step], v)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        ids.append(vid[best])
        distances.append(np.take_along_axis(d, best, 1))
    return np.concatenate(ids), np.concatenate(distances)


def _nearest(metric: str, qid: list, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int):
    """(query ids, vector ids, distances): the k nearest of a batch for each query, ties by id."""
    ids, d = _k_nearest(metric, q, vid, v, k)
    return [x for x in qid for _ in range(ids.shape[1])], ids.ravel(), d.ravel()


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, metric: str = "l2",
                 query_id: str = "query_id", query_vec: str = "embedding",
                 vec_id: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id) for the ``min(k, count)`` nearest vectors of the query's dimension.

    Ranked by the exact double distance, then the lower id. Null vectors take
    no part. Raises when the collection is empty. The queries are read in
    blocks of QUERY_BLOCK_BYTES, one scan of the vectors for each block, and
    broadcast as matrices. A task holds a block, a batch, distances of
    DISTANCE_CELLS pairs and k vectors per query, however many there are.
    """
    require_rows(vectors, "vector in the collection")
    spark = vectors.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q")).where("q IS NOT NULL")
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    blocks = max(1, -(-n * (8 * (width or 1) + 64) // QUERY_BLOCK_BYTES))
    q_type, v_type = q.schema["query_id"].dataType.simpleString(), v.schema["vec_id"].dataType.simpleString()
    schema = f"query_id {q_type}, vec_id {v_type}, distance double"
    q_arrow = to_arrow_type(q.schema["query_id"].dataType)

    def compared(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, found, kind = block.value, {}, None
            for b in batches:
                kind = b.schema.field(0).type
                ids, col = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                sizes = np.asarray(col.value_lengths())
                flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
                for s, (_, q_rows) in parts.items():
                    at = np.flatnonzero(sizes == s)
                    for lo in range(0, len(at), VECTOR_STEP):
                        mine = at[lo:lo + VECTOR_STEP]
                        rows = flat[(ends[mine] - s)[:, None] + np.arange(s)[None, :]].astype(float).reshape(len(mine), s)
                        near = _k_nearest(metric, q_rows, ids[mine], rows, k)
                        # a task keeps k per query, whatever the number of its batches
                        found[s] = _best(*(np.concatenate(x, axis=1) for x in zip(found[s], near)), k) if s in found else near
            for s, (near, distance) in found.items():
                qid, n = parts[s][0], near.shape[1]
                for lo in range(0, len(qid), VECTOR_STEP):
                    hi = lo + VECTOR_STEP
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x for x in qid[lo:hi] for _ in range(n)], q_arrow), pa.array(near[lo:hi].ravel(), kind),
                         pa.array(distance[lo:hi].ravel(), pa.float64())], names=["query_id", "vec_id", "distance"])
        return run

    def matrices(part: DataFrame) -> dict[int, tuple[list, np.ndarray]]:
        by_size: dict[int, tuple[list, list]] = {}
        for i, x in part.toLocalIterator():
            ids, rows = by_size.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(np.array(x, float))
        return {s: (ids, np.array(rows).reshape(len(ids), s)) for s, (ids, rows) in by_size.items()}

    out = None
    for i in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        block = spark.sparkContext.broadcast(matrices(part))
        near = v.mapInArrow(compared(block), schema)
        out = near if out is None else out.unionByName(near)
    return top_k_per_group(out, "query_id", [F.col("distance"), F.col("vec_id")], k).select("query_id", "rank", "vec_id")


# ---- text retrieval (BM25) -----------------------------------------------------

def _bm25_batch(ids: np.ndarray, tokens_of: pa.ListArray, terms_of: pa.Array, idf: np.ndarray, avgdl: float,
                wanted: list[tuple[object, list[int]]], k: int) -> Iterator[tuple[object, object, float]]:
    """(query id, chunk id, score) of the k best chunks of a batch for each query; ties by id.

    A score is summed over the query's terms in order, so equal chunks get
    equal scores in any batch.
    """
    dl = np.asarray(tokens_of.value_lengths()).astype(float)
    term = pc.index_in(tokens_of.flatten(), terms_of).fill_null(-1).to_numpy(zero_copy_only=False)
    cell = (np.repeat(np.arange(len(ids)), dl.astype(int)) * len(terms_of) + term)[term >= 0]
    tf = np.bincount(cell, minlength=len(ids) * len(terms_of)).astype(float).reshape(len(ids), len(terms_of))
    weight = idf * (tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl[:, None] / avgdl)))
    columns = np.ascontiguousarray(weight.T)
    for query, terms in wanted:
        score = np.zeros(len(ids))
        for t in terms:
            score += columns[t]
        hit = np.flatnonzero(score > 0)
        if len(hit) > k:
            hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
        for i in sorted(hit, key=lambda i: (-score[i], ids[i]))[:k]:
            yield query, ids[i], float(score[i])


def text_top_k(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, query_id: str = "query_id",
               query_text: str = "text", chunk_id: str = "id", chunk_text_col: str = "text") -> DataFrame:
    """(query_id, rank, id): the ``k`` best chunks per query by BM25; ties by id.

    The tokenised chunks are materialised once (one pass over the texts,
    whatever feeds them). The queries are the stated set: they are read in
    blocks of at most QUERY_BLOCK_TERMS (query, term) pairs; for a block, the
    document frequencies of its terms are counted with map-side combining, and
    every batch of chunks is scored as a (chunk, term) matrix that hands on
    its k best per query -- no (query, chunk) pair is shuffled beyond those.
    A null text has no token. Raises when there is no chunk.
    """
    spark = chunks.sparkSession
    checkpoint_dir(spark)
    none = F.array().cast("array<string>")
    base = chunks.select(F.col(chunk_id).alias("id"), F.coalesce(tokens(F.col(chunk_text_col)), none).alias("tok")).checkpoint()
    n_docs, avgdl = base.agg(F.count(F.lit(1)), F.avg(F.size("tok"))).first()
    if not n_docs:
        raise RuntimeError("no chunk in the collection")
    q = queries.select(F.col(query_id).alias("query_id"),
                       F.array_sort(F.array_distinct(F.coalesce(tokens(F.col(query_text)), none))).alias("terms"))
    total = q.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_BLOCK_TERMS))
    q_arrow = to_arrow_type(q.schema["query_id"].dataType)
    schema = (f"query_id {q.schema['query_id'].dataType.simpleString()}, "
              f"id {base.schema['id'].dataType.simpleString()}, score double")

    def scored(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, idf, wanted = shared.value
            terms_of = pa.array(held, pa.string())
            step = max(1, SCORE_CELLS // max(1, len(held)))
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    found = list(_bm25_batch(np.array(part.column(0).to_pylist(), object), part.column(1),
                                             terms_of, idf, avgdl, wanted, k))
                    qs, ids, scores = zip(*found) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qs, q_arrow), pa.array(ids, part.schema.field(0).type), pa.array(scores, pa.float64())],
                        names=["query_id", "id", "score"])
        return run

    out = None
    for i in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        terms = mine.select(F.explode("terms").alias("term")).distinct()
        uses = (base.select(F.explode(F.array_distinct("tok")).alias("term")).join(terms, "term", "left_semi")
                .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        weights = uses.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        held = sorted((r["term"], r["idf"]) for r in weights.collect())
        at = {t: j for j, (t, _) in enumerate(held)}
        wanted = [(r["query_id"], [at[t] for t in r["terms"] if t in at]) for r in mine.collect()]
        shared = spark.sparkContext.broadcast(([t for t, _ in held], np.array([w for _, w in held]), wanted))
        part = base.mapInArrow(scored(shared), schema)
        out = part if out is None else out.unionByName(part)
    ranked = top_k_per_group(out, "query_id", [F.col("score").desc(), F.col("id")], k)
    return ranked.select("query_id", "rank", "id")


# ---- context and sources -------------------------------------------------------

def build_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context): ``Source: s, page p\\nText: t`` blocks in rank order,
    separated by a blank line. Each query holds at most k blocks."""
    j = hits.join(chunks.select("id", "source", "page", "text"), "id")
    block = F.concat(F.lit("Source: "), F.col("source"), F.lit(", page "), F.col("page").cast("string"),
                     F.lit("\nText: "), F.col("text"))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_a"))
    return g.select("query_id", F.array_join(F.transform("_a", lambda x: x["b"]), "\n\n").alias("context"))


def source_list(hits: DataFrame, chunks: DataFrame, sep: str = "; ") -> DataFrame:
    """(query_id, sources): ``name (page N)`` de-duplicated, first occurrence
    (best rank) wins, in rank order."""
    j = hits.join(chunks.select("id", "source", "page"), "id")
    label = F.concat(F.col("source"), F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("l")))).alias("_a"))
    return g.select("query_id",
                    F.array_join(F.array_distinct(F.transform("_a", lambda x: x["l"])), sep).alias("sources"))


def index_upsert(index: DataFrame, batch: DataFrame, replace_sources: bool = False) -> DataFrame:
    """Upsert chunk records by id. An id that several rows of the batch share
    (files whose names differ in the ending only) keeps the row whose source is
    last in order. Ids absent from the batch stay (stale chunks
    of a shrunk document are kept) unless ``replace_sources`` drops every old
    chunk of a source that the batch re-indexes."""
    from ledgerline.operators.rewrite import upsert_by_key

    if replace_sources:
        index = index.join(batch.select("source").distinct(), "source", "left_anti").select(*index.columns)
    return upsert_by_key(index, batch.select(*index.columns), "id", ["source", "page", "chunk", "text"])
