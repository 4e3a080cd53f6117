"""Incremental document ingest with Structured Streaming.

The reference re-runs its ingest over all documents and upserts chunk ids,
so a re-run never duplicates chunks. Here new document files arriving in a
folder are picked up by a file stream; every micro-batch is chunked and
upserted into the chunk index, and the result is published as a new index
version only after its checks pass (``operators.versions``). The index lies in
buckets by the stem of the source's name, of which the chunk ids are made:
a batch reads and writes the buckets of its sources alone.

Re-running an epoch (after a failure) writes the same chunk ids with the
same text, so the upsert is idempotent; the stream's checkpoint (in the
shared checkpoint folder) records which files were consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import file_stem
from ledgerline.operators import quality as Q
from ledgerline.operators import retrieval as R
from ledgerline.operators import versions as V

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
INDEX_SCHEMA = "id string, source string, page int, chunk int, text string"


def index_checks(chunks: DataFrame) -> DataFrame:
    return Q.run_checks([Q.check_unique(chunks, ["id"], "chunks.id"),
                         Q.check_not_null(chunks, ["id", "source", "text"], "chunks")])


def current_index(spark: SparkSession, index_base: str) -> DataFrame:
    return V.read(spark, index_base, V.latest(spark, index_base), INDEX_SCHEMA)


def upsert_batch(index_base: str, chunk_size: int = R.CHUNK_SIZE, overlap: int = R.CHUNK_OVERLAP):
    """foreachBatch function: chunk the new documents and publish the upserted index.

    Page numbers come with the files, so the pages of a source may arrive in
    any number of batches. A page without a number stops the batch.
    """
    def run(batch: DataFrame, epoch_id: int) -> None:
        checked = F.when(F.col("page").isNull(), F.raise_error(F.lit("a page without its number"))).otherwise(F.col("page"))
        chunks = R.chunk_records(batch.select("source", checked.cast("int").alias("page"), "text"), chunk_size, overlap)
        V.upsert(chunks, index_base, INDEX_SCHEMA, file_stem(F.col("source")), R.index_upsert, index_checks)
    return run


def start_ingest(spark: SparkSession, source_dir: str, index_base: str, checkpoint_location: str | None = None,
                 available_now: bool = True):
    """Start (and with ``available_now`` run to completion) the ingest stream."""
    from ledgerline.session import checkpoint_dir

    location = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/ingest-stream"
    stream = spark.readStream.schema(DOCUMENT_SCHEMA).parquet(source_dir)
    writer = (stream.writeStream.foreachBatch(upsert_batch(index_base))
              .option("checkpointLocation", location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
