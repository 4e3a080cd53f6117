"""Target-distribution importance resampling over hashed features, with length-bucketed CRC matrices.

A document's features are its runs of 1 to ``ngram`` consecutive words, each
hashed into one of ``buckets`` buckets by its CRC-32. How often a bucket
occurs in the target texts against all documents gives the bucket's gain, the
sum of gains over a document's features its weight, and weight plus seeded
Gumbel noise its score; the highest scores are drawn without replacement in
proportion to the weights.

Hashing: the distinct features of a block of texts are grouped by their length
in bytes, each group is one two-dimensional uint8 array, and a CRC step runs
over a column of it, that is over all features of the group at once; the
buckets are scattered back to the features' uses. A feature of more than
PART bytes is cut into parts of that length, which are the rows of such an
array, and the parts' registers are joined by the step for PART zero bytes
(the register is linear in what it reads).

The texts are read once: bucket counts per document are written as a table,
from which the totals (summed per task, then per bucket) and the weights
follow. Only the gains, one number per bucket, reach the driver. Ranks come
from ``partitioning.number_within``: equi-depth bins of scores, no global
sort in one task.

Defined results: a null text has no word (weight 0). A null doc_id reads as
empty in the noise's seed and follows all others in ties; rows that share
doc_id, score, features and weight rank in any order. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import stored
from ledgerline.llm.term_bytes import Numbered, term_lists
from ledgerline.operators.partitioning import number_within

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
BLOCK_BYTES = 4 << 20
PART = 1024
POLYNOMIAL = 0xEDB88320     # fixed value: CRC-32, reflected
LAST = (1 << 63) - 1
COUNTED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"


# ---- CRC-32 over matrices ---------------------------------------------------------

def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _byte_table()


def _zeros_step(n: int) -> np.ndarray:
    """The registers that the 32 single bits become after ``n`` zero bytes."""
    r = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        r = TABLE[r & 255] ^ (r >> 8)
    return r


def _columns(matrix: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers after all columns of a uint8 matrix, one row per register."""
    for column in np.ascontiguousarray(matrix.T):
        register = TABLE[(register ^ column) & 255] ^ (register >> 8)
    return register


def _long_crc(feature: bytes, step: np.ndarray) -> int:
    head = len(feature) % PART
    register = _columns(np.frombuffer(feature, np.uint8, head).reshape(1, head), np.array([0xFFFFFFFF], np.uint32))[0]
    parts = np.frombuffer(feature, np.uint8, len(feature) - head, head).reshape(-1, PART)
    bits = np.arange(32, dtype=np.uint32)
    for r in _columns(parts, np.zeros(len(parts), np.uint32)):
        register = np.bitwise_xor.reduce(step[(register >> bits) & 1 == 1], initial=np.uint32(0)) ^ r
    return int(register) ^ 0xFFFFFFFF


def crc32s(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, as int64."""
    out = np.zeros(len(features), np.int64)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    step = None
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(group):
            continue
        size = sizes[group[0]]
        if size > PART:
            step = _zeros_step(PART) if step is None else step
            out[group] = [_long_crc(features[i], step) for i in group]
        else:
            matrix = np.frombuffer(b"".join([features[i] for i in group]), np.uint8).reshape(len(group), size)
            out[group] = _columns(matrix, np.full(len(group), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
    return out


# ---- features ---------------------------------------------------------------------

def _with_runs(words: list[bytes], ngram: int) -> list[bytes]:
    return words + [b" ".join(words[i:i + k]) for k in range(2, ngram + 1) for i in range(len(words) - k + 1)]


def _counted_block(texts: list[str], ngram: int, buckets: int):
    """Per text (words, features, its buckets in order, their counts)."""
    seen, uses, sizes, n_words = Numbered(), [], [], []
    for text in texts:
        lists = list(term_lists(text))
        n_words.append(sum(map(len, lists)))
        if ngram > 1:
            lists = [_with_runs([w for ws in lists for w in ws], ngram)]
        ids = [np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws)) for ws in lists]
        uses.append(np.concatenate(ids) if ids else np.empty(0, np.int64))
        sizes.append(len(uses[-1]))
    bucket = crc32s(list(seen)) % buckets
    row = np.repeat(np.arange(len(texts)), sizes)
    cell, count = np.unique(row * buckets + bucket[np.concatenate(uses)] if row.size else row, return_counts=True)
    ends = np.searchsorted(cell, np.arange(len(texts) + 1) * buckets)
    return np.array(n_words, np.int64), np.array(sizes, np.int64), ends, (cell % buckets).astype(np.int32), count.astype(np.int32)


def bucket_counts(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of each row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(batch.column("text")[i].as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or i == batch.num_rows - 1:
                    n_words, n_features, ends, cell, count = _counted_block(texts, ngram, buckets)
                    offsets = pa.array(ends, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(lo, len(texts)), pa.array(n_words), pa.array(n_features),
                         pa.ListArray.from_arrays(offsets, pa.array(cell)), pa.ListArray.from_arrays(offsets, pa.array(count))],
                        names=["doc_id", "n_words", "n_features", "buckets", "counts"])
                    lo, texts, size = i + 1, [], 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COUNTED)


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): uses of each bucket over all rows; one array of totals per task, then a sum per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            np.add.at(total, b, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])
    return counted.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that occur in one of the two totals."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    sums = corpus.agg(F.sum("n").alias("n")).first()["n"] or 0, target.agg(F.sum("n").alias("n")).first()["n"] or 0
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in "st")
    all_s, all_t = (F.lit(float(n + buckets)) for n in sums)
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * all_s / ((s + 1) * all_t))).alias("gain"))


def weighted(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight)."""
    shared = counted.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
            ends = np.concatenate([[0], np.cumsum(batch.column("buckets").value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared.value[b] * n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    ``target`` holds (text). floor(percent * N / 100) of the N documents of
    ``min_words`` words and more are drawn.
    """
    counted = stored(bucket_counts(docs.select("doc_id", "text"), ngram, buckets))
    wanted = bucket_totals(bucket_counts(target.select(F.lit(0).alias("doc_id"), "text"), ngram, buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in gains(stored(bucket_totals(counted, buckets)), stored(wanted), buckets).collect():   # at most ``buckets`` rows
        gain[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = stored(weighted(counted, gain).withColumn("score", F.col("weight") + noise))
    fit = F.col("n_words") >= min_words
    n = scored.where(fit).count()
    ranked = number_within(
        scored.where(fit).withColumns({"falling": -F.col("score"), "id": F.coalesce("doc_id", F.lit(LAST))}),
        [], ["falling", "id", "n_features", "weight"], "rank")
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank").cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return (ranked.select(*columns, drawn.alias("rank"))
            .unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank"))))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
