"""Sharding: two-pass external shuffle.

Pass 1 scatters the records by a seeded hash of their contents into buckets
of a bounded size (``bucket_bytes``), one shuffle partition each. Pass 2
brings each bucket, in a fixed order, through Spark's ``shuffle`` function
(a seeded Fisher-Yates permutation) and numbers the result: the place of a
record is the rows of the buckets before its own plus its place inside. The
shards are equal stretches of that order (law ``rows``: counts at most one
apart), so a bucket is written to one or two shards without another shuffle.

Only DataFrame functions are used. The number of buckets follows the bytes
of the input, so no task grows with it; repeated rows are numbered before
they are scattered, so a third of all rows being equal fills no bucket. The
permutation depends on the seed, the rows and the number of buckets alone: a
task that is run again gives the same places.

Defined results: a null text has size 1 and CRC 0; an empty table gives no
rows; repeated rows are distinct records. All input columns are kept by
``assign``; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import collapse_repeats, expand, fresh, has_maps, row_columns, row_key

SHARDS = 16
SEED = 20_260_101
BUCKET_BYTES = 64 << 20
MIN_BUCKETS = 64


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bucket_count(total_bytes: int | None, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(MIN_BUCKETS, -(-(total_bytes or 0) // bucket_bytes))


def _by_key(*fields: str):
    """Comparison of records by ``fields`` alone (a record with a map has no order of its own)."""
    def compare(x: Column, y: Column) -> Column:
        one, other = (F.struct(*[r.getField(f) for f in fields]) for r in (x, y))
        return F.when(one < other, -1).when(one > other, 1).otherwise(0)
    return compare


def assign(df: DataFrame, n_buckets: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    count, copy, a, b, h, bucket, rec, rank = fresh(df, "_s", 8)
    columns = [F.col(f"`{c}`") for c in df.columns]
    ka, kb = row_key(row_columns(df))
    rows = expand(collapse_repeats(df, count), count, copy).withColumns({a: ka, b: kb})
    rows = rows.withColumn(h, F.xxhash64(F.lit(seed), a, b, copy))
    rows = rows.withColumn(bucket, F.pmod(h, F.lit(n_buckets)).cast("int"))

    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           F.sum("n").over(Window.partitionBy()).alias("total"))

    scattered = rows.repartitionById(n_buckets, F.col(bucket))
    records = F.collect_list(F.struct(F.col(h), F.col(a), F.col(b), F.col(copy), F.struct(*columns).alias("row")))
    packed = scattered.groupBy(bucket).agg(
        (F.array_sort(records, _by_key(h, a, b, copy)) if has_maps(df) else F.array_sort(records)).alias(rec))
    dealt = packed.select(bucket, F.posexplode(F.shuffle(rec, seed)).alias("place", "rec"))
    # one row per bucket: bounded by total bytes / bucket_bytes
    dealt = dealt.join(F.broadcast(offsets), bucket)
    dealt = dealt.withColumn(rank, F.col("first") + F.col("place"))
    r, n = f"`{rank}`", "total"
    return (dealt.withColumn("_shard", F.expr(f"({shards} * ({r} + 1) + {n} - 1) div {n} - 1"))
            .select("rec.row.*", F.col("_shard").cast("int").alias("shard"),
                    F.expr(f"{r} - (_shard * {n}) div {shards}").alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Whole documents with their shard and slot."""
    total = docs.agg(F.sum(record_size(F.col("text")))).first()[0]
    return assign(docs, bucket_count(total, bucket_bytes), shards, seed)


def write_shards(docs: DataFrame, path: str) -> None:
    """Write the rows of ``assign`` as one folder per shard, ordered by slot inside each file."""
    docs.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Contract columns of every document: the same operator over the records' digests."""
    light = docs.select("doc_id", record_size(F.col("text")).alias("size"),
                        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    total = light.agg(F.sum("size")).first()[0]
    return assign(light, bucket_count(total, bucket_bytes), shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
