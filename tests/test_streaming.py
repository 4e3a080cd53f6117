import os

from ledgerline.operators import versions as V
from ledgerline.streaming import ingest


def test_stream_ingest_upserts(spark, tmp_out):
    src = os.path.join(tmp_out, "incoming")
    base = os.path.join(tmp_out, "index")
    ckpt = os.path.join(tmp_out, "ckpt")
    first = spark.createDataFrame([(1, "a.pdf", 1, "alpha " * 100), (2, "b.pdf", 1, "beta")], ingest.DOCUMENT_SCHEMA)
    first.write.parquet(os.path.join(src, "batch1"))
    q = ingest.start_ingest(spark, os.path.join(src, "*"), base, ckpt)
    q.awaitTermination(120)
    v1 = V.latest(spark, base)
    ids1 = {r["id"] for r in ingest.current_index(spark, base).collect()}
    assert ids1 == {"a_p1_c1", "a_p1_c2", "b_p1_c1"}
    # a shorter a.pdf arrives: chunk 1 is replaced, the stale chunk 2 stays (as the reference)
    spark.createDataFrame([(1, "a.pdf", 1, "gamma"), (7, "b.pdf", 2, "second page")], ingest.DOCUMENT_SCHEMA).write.parquet(os.path.join(src, "batch2"))
    q = ingest.start_ingest(spark, os.path.join(src, "*"), base, ckpt)
    q.awaitTermination(120)
    v2 = V.latest(spark, base)
    assert v2.number == v1.number + 1
    rows = {r["id"]: r["text"] for r in ingest.current_index(spark, base).collect()}
    # a page that comes in a later batch keeps the pages before it
    assert set(rows) == ids1 | {"b_p2_c1"} and rows["a_p1_c1"] == "gamma" and rows["b_p1_c1"] == "beta"
    # a batch of one source writes its bucket only; the version before is still readable
    spark.createDataFrame([(9, "b.pdf", 3, "third page")], ingest.DOCUMENT_SCHEMA).write.parquet(os.path.join(src, "batch3"))
    q = ingest.start_ingest(spark, os.path.join(src, "*"), base, ckpt)
    q.awaitTermination(120)
    v3 = V.latest(spark, base)
    assert sum(v3.folders[b] != v2.folders.get(b) for b in v3.folders) == 1
    assert ingest.current_index(spark, base).count() == 5 and V.read(spark, base, v2, ingest.INDEX_SCHEMA).count() == 4
