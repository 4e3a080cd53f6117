"""A stored partition index for exact nearest vectors.

``build`` fits centroids on a bounded sample (at most ``SAMPLE_BYTES`` of
vectors, those whose id hashes lowest; a few rounds of k-means for every
dimension that occurs), then puts *every* vector with its nearest centroid and
cuts each cell, in order of the distance to the centroid, into blocks of
bounded bytes. A block is therefore a shell around its centroid: it stores the
least and largest distance of its vectors. A cell of any size is many blocks.

``search`` rests on the triangle inequality: a vector at distance r from a
centroid is at least |d(query, centroid) - r| from the query. The two blocks
of the query's own cell whose shells lie nearest are compared first; the k-th
distance found there is a ceiling, and only blocks whose shell comes within it
are compared after them. The ranking is by the same distances as
``retrieval.vector_top_k``, so the result is exact at any quality of the fit;
the fit decides how much is skipped. Metric l2 or cosine (as unit vectors).

Defined results: null vectors take no part; a vector of another dimension is
never compared; vectors with a null or NaN (or of length zero under cosine)
sort last and are never skipped. Raises when there is no vector. Query ids are
unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.operators.partitioning import number_within, top_k_per_group
from ledgerline.operators.retrieval import TOP_K, _nearest, require_rows
from ledgerline.session import checkpoint_dir

SAMPLE_BYTES = 32 << 20
MAX_CELLS = 1024
ROUNDS = 6
BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 256
FIRST_BLOCKS = 2
QUERY_BLOCK = 256         # queries of one comparison, on average
ASSIGN_CELLS = 2_000_000  # cells of a distance matrix
SLACK = 1e-9              # relative to the distances that enter a bound
COSINE_SLACK = 1e-6       # 1 - cos is rounded near 0, its root is not finer than this


@dataclass(frozen=True)
class VectorIndex:
    path: str
    metric: str
    centroids: dict[int, np.ndarray]     # dimension -> centroids, at most MAX_CELLS

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")


def _place(x: np.ndarray, metric: str) -> np.ndarray:
    """The points among which distances are Euclidean."""
    if metric != "cosine":
        return x
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


def _to_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - centroids[None, :, :]) ** 2).sum(2), 0.0))


def _steps(n: int, centroids: np.ndarray) -> Iterator[slice]:
    step = max(1, ASSIGN_CELLS // max(1, centroids.size))
    return (slice(lo, lo + step) for lo in range(0, n, step))


def _fit(x: np.ndarray, cells: int) -> np.ndarray:
    """At most ``cells`` centroids of the finite rows of ``x``: k-means from evenly spaced rows."""
    x = np.unique(x[np.isfinite(x).all(1)], axis=0)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = np.concatenate([_to_centroids(x[s], c).argmin(1) for s in _steps(len(x), c)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _rows_by_size(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a batch's vectors."""
    col = b.column(column)
    sizes = np.asarray(col.value_lengths())
    flat, ends = col.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes)
    for s in np.unique(sizes):
        at = np.flatnonzero(sizes == s)
        yield int(s), at, flat[(ends[at] - s)[:, None] + np.arange(s)[None, :]].reshape(len(at), s)


def build(vectors: DataFrame, path: str, metric: str = "l2", vec_id: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Write the index of ``vectors`` to the new folder ``path``."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no bound for the metric {metric}")
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    require_rows(vectors, "vector in the collection")
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL").checkpoint()
    n, width = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 1)
    share = min(1.0, SAMPLE_BYTES / (8 * width) / max(n, 1))
    sample = v.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int(share * (1 << 40)))
    by_size: dict[int, list] = {}
    for r in sample.select("v").collect():
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    centroids = {s: _fit(_place(np.array(x, float).reshape(len(x), s), metric), int(min(MAX_CELLS, max(1, (len(x) / share) ** 0.5))))
                 for s, x in by_size.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, at, x in _rows_by_size(b, 1):
                c = centroids.get(s, np.zeros((1, s)))
                for part in _steps(len(at), c):
                    d = _to_centroids(_place(x[part], metric), c)
                    cell = np.where(np.isnan(d), np.inf, d).argmin(1)
                    dist = d[np.arange(len(cell)), cell]
                    rows = b.take(pa.array(at[part]))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(np.full(len(cell), s), pa.int32()), pa.array(cell, pa.int32()),
                         pa.array(np.where(np.isnan(dist), np.inf, dist), pa.float64())], names=["vec_id", "v", "size", "cell", "r"])

    kind = v.schema["vec_id"].dataType.simpleString()
    placed = v.mapInArrow(assign, f"vec_id {kind}, v array<double>, size int, cell int, r double").checkpoint()
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    numbered = number_within(placed, ["size", "cell"], ["r", "vec_id", "v"], "at")
    blocks = numbered.withColumn("block", F.floor((F.col("at") - 1) / rows)).groupBy("size", "cell", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"),
        F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("p"))
    blocks.select("size", "cell", "block", "n", "r_min", "r_max", F.col("p.vec_id").alias("ids"), F.flatten("p.v").alias("vs")) \
        .write.parquet(f"{path}/blocks")
    return VectorIndex(path, metric, centroids)


def _reach(queries: DataFrame, index: VectorIndex, nearest: bool) -> DataFrame:
    """(query_id, size, cell, d, ceiling): each query's nearest cell, or all cells of its dimension."""
    centroids, metric = index.centroids, index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, at, x in _rows_by_size(b, 1):
                c = centroids.get(s, np.zeros((1, s)))
                for part in _steps(len(at), c):
                    d = _to_centroids(_place(x[part], metric), c)
                    d = np.where(np.isnan(d), np.inf, d)
                    if nearest:
                        row, cell = np.arange(len(d)), d.argmin(1)
                    else:
                        row, cell = (a.ravel() for a in np.indices(d.shape))
                    rows = b.take(pa.array(at[part][row]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(np.full(len(row), s), pa.int32()), pa.array(cell, pa.int32()),
                         pa.array(d[row, cell], pa.float64()), rows.column(2)], names=["query_id", "size", "cell", "d", "ceiling"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "q", "ceiling").mapInArrow(run, f"query_id {kind}, size int, cell int, d double, ceiling double")


def _gap() -> F.Column:
    """Least distance from a query at ``d`` to a shell; 0 where a distance is not finite."""
    d, lo, hi = F.col("d"), F.col("r_min"), F.col("r_max")
    finite = (d < float("inf")) & (hi < float("inf"))
    return F.when(finite, F.greatest(d - hi, lo - d, F.lit(0.0)) - SLACK * (d + hi)).otherwise(F.lit(0.0))


def _compared(q: DataFrame, pairs: DataFrame, index: VectorIndex, k: int, salts: int) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest of each block for each of its queries."""
    key = ["size", "cell", "block", "salt"]
    asked = pairs.join(q.select("query_id", "q"), "query_id").select(
        "size", "cell", "block", F.pmod(F.xxhash64("query_id"), F.lit(salts)).alias("salt"), "query_id", "q")
    needed = asked.select(*[F.col(c).alias(c) for c in key]).distinct()     # columns of their own: both sides meet again
    rows = index.blocks(q.sparkSession).select("size", "cell", "block", "ids", "vs").join(needed, key[:3])
    kinds = rows.select(F.get("ids", F.lit(0)).alias("vec_id")).schema
    schema = q.select("query_id").schema.add(kinds["vec_id"]).add("distance", "double")
    arrow, metric = to_arrow_schema(schema), index.metric

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        size = left["size"][0].as_py()
        ids = right["ids"].combine_chunks().flatten()
        v = right["vs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), size)
        x = left["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(left.num_rows, size)
        # ids stand in their order, so positions break ties as ids do
        row, at, distance = _nearest(metric, list(range(left.num_rows)), x, np.arange(len(ids)), v, k)
        return pa.Table.from_arrays([left["query_id"].combine_chunks().take(pa.array(row, pa.int64())).cast(arrow.field(0).type),
                                     ids.take(pa.array(at, pa.int64())).cast(arrow.field(1).type),
                                     pa.array(distance, pa.float64())], schema=arrow)

    return asked.groupBy(*key).cogroup(rows.select(*key, "ids", "vs").groupBy(*key)).applyInArrow(compare, schema)


def _search(queries: DataFrame, index: VectorIndex, k: int, query_id: str, query_vec: str) -> tuple[DataFrame, DataFrame]:
    """((query_id, vec_id, distance) found, (query_id, size, cell, block, n) compared)."""
    spark = queries.sparkSession
    checkpoint_dir(spark)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("q")).where("q IS NOT NULL")
    q = q.withColumn("ceiling", F.lit(None).cast("double")).checkpoint()
    salts = max(1, q.count() // QUERY_BLOCK)
    heads = index.blocks(spark).select("size", "cell", "block", "n", "r_min", "r_max")
    near = _reach(q, index, nearest=True).join(heads, ["size", "cell"]).withColumn("gap", _gap())
    first = top_k_per_group(near, "query_id", [F.col("gap"), F.col("block")], FIRST_BLOCKS).select("query_id", "size", "cell", "block", "n").checkpoint()
    early = _compared(q, first, index, k, salts).checkpoint()
    kth = F.col("distance") if index.metric == "l2" else 2 * F.col("distance")
    ceilings = (top_k_per_group(early, "query_id", [F.col("distance"), F.col("vec_id")], k).where(F.col("rank") == k)
                .select("query_id", (F.sqrt(F.greatest(kth, F.lit(0.0))) * (1 + SLACK) + (COSINE_SLACK if index.metric == "cosine" else 0.0)).alias("ceiling")))
    known = q.drop("ceiling").join(ceilings, "query_id", "left")
    within = F.col("ceiling").isNull() | F.isnan("ceiling") | (F.col("gap") <= F.col("ceiling"))
    rest = (_reach(known, index, nearest=False).join(heads, ["size", "cell"]).withColumn("gap", _gap()).where(within)
            .select("query_id", "size", "cell", "block", "n").join(first, ["query_id", "size", "cell", "block"], "left_anti").checkpoint())
    return early.unionByName(_compared(q, rest, index, k, salts)), first.unionByName(rest)


def search(queries: DataFrame, index: VectorIndex, k: int = TOP_K, query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id) for the ``min(k, count)`` nearest vectors of the query's dimension; ties by id."""
    found, _ = _search(queries, index, k, query_id, query_vec)
    return top_k_per_group(found, "query_id", [F.col("distance"), F.col("vec_id")], k).select("query_id", "rank", "vec_id")


def work(queries: DataFrame, index: VectorIndex, k: int = TOP_K, query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """(query_id, compared): the number of vectors that ``search`` compares with each query."""
    _, pairs = _search(queries, index, k, query_id, query_vec)
    return pairs.groupBy("query_id").agg(F.sum("n").alias("compared"))
