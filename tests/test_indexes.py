"""Stored indexes against the plain searches and brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import token_text, tokens
from ledgerline.operators import retrieval as R
from ledgerline.operators import text_index, vector_index


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_text_index_equals_plain_search(spark, tmp_out):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    chunks = [(f"c{i:04d}", " ".join(rnd.choices(vocabulary, weights, k=rnd.randint(1, 40)))) for i in range(900)]
    chunks += [("t1", "w250 w250 tie"), ("t0", "w250 w250 tie"), ("empty", ""), ("null", None)]
    chunks += [(f"hot{i}", "w0 w1 w2") for i in range(300)]
    queries = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 6)))) for i in range(60)]
    queries += [(100, "tie"), (101, "absent"), (102, ""), (103, None), (104, "w0 w1 w2"), (104, "w0 w1 w2")]
    c = spark.createDataFrame(chunks, "id string, text string")
    q = spark.createDataFrame(queries, "query_id int, text string")
    index = text_index.build(c, f"{tmp_out}/index", slice_chunks=64)
    want = _rows(R.text_top_k(q.dropDuplicates(["query_id"]), c, k=4), ["query_id", "rank", "id"])
    assert _rows(text_index.search(q, index, k=4), ["query_id", "rank", "id"]) == want
    tie = [r for r in want if r[0] == 100]
    assert tie == [(100, 1, "t0"), (100, 2, "t1")]


def test_text_index_reads_only_blocks_that_can_win(spark, tmp_out):
    chunks = [(f"c{i:05d}", f"common filler{i % 7}" + (" rare" if i in (10, 900) else "")) for i in range(2000)]
    c = spark.createDataFrame(chunks, "id string, text string")
    index = text_index.build(c, f"{tmp_out}/index", slice_chunks=100)
    q = spark.createDataFrame([(1, "common rare")], "query_id int, text string")
    assert _rows(text_index.search(q, index, k=2), ["rank", "id"]) == [(1, "c00010"), (2, "c00900")]
    w = text_index.work(q, index, k=2).first()
    assert w["all_postings"] == 4002 and w["term_postings"] == 2002
    assert w["read_postings"] <= 500     # the slices with the rare term


def test_text_index_rows_and_slices_are_bounded(spark, tmp_out):
    chunks = [("same", f"common w{i % 50}") for i in range(3000)] + [(None, "common rare")] * 40
    c = spark.createDataFrame(chunks, "id string, text string").coalesce(1)
    index = text_index.build(c, f"{tmp_out}/index", slice_chunks=1000)
    postings = index.table(spark, "postings")
    assert postings.agg(F.max("n"), F.sum("n")).first() == (text_index.ROW_POSTINGS, 6080)
    assert sorted(r["count"] for r in index.table(spark, "chunks").groupBy("slice").count().collect()) == [40, 1000, 1000, 1000]
    q = spark.createDataFrame([(1, "rare"), (2, "w7"), (3, "common")], "query_id int, text string")
    found = text_index.search(q, index, k=70)
    assert sorted((r["query_id"], str(r["id"]), r["n"]) for r in found.groupBy("query_id", "id").agg(F.count("*").alias("n")).collect()) == \
        [(1, "None", 40), (2, "same", 60), (3, "None", 40), (3, "same", 30)]


def test_token_text_joins_the_tokens(spark):
    texts = ["", " ", None, "a", "  Ab--c\u00a0d\t", "ÉTÉ 2x ½ ٣ 漢字\u200bz", "…", "İi ß", "a\nb\x1c c", "😀x😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(token_text(F.col("t")).alias("a"), F.array_join(tokens(F.col("t")), " ").alias("b")).collect():
        assert r["a"] == r["b"]


def test_text_index_slices_hold_bounded_text(monkeypatch):
    monkeypatch.setattr(text_index, "SLICE_BYTES", 10)
    texts = ["a" * 4, "b" * 6, "", "c" * 25, "d", "e", "f", "g" * 9, "h" * 2]
    batches = [pa.record_batch([pa.array([0] * len(t)), pa.array(t, pa.string()), pa.array(t, pa.string())], names=["part", "id", "words"]) for t in (texts[:2], texts[2:5], [], texts[5:])]
    got = [(n, [len(x) for x in rows["words"].to_pylist()]) for n, rows in text_index._slices(iter(batches), 3)]
    assert got == [(0, [4, 6, 0]), (1, [25]), (2, [1, 1, 1]), (3, [9]), (4, [2])]


def test_indexes_of_nothing_raise(spark, tmp_out):
    with pytest.raises(RuntimeError):
        text_index.build(spark.createDataFrame([], "id string, text string"), f"{tmp_out}/t")
    with pytest.raises(RuntimeError):
        vector_index.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), f"{tmp_out}/v")
    with pytest.raises(ValueError):
        vector_index.build(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), f"{tmp_out}/w", metric="ip")


def _clustered(n, seed):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(20, 8)) * 10
    x = centers[rnd.integers(0, 20, n)] + rnd.normal(size=(n, 8)) * 0.3
    return [(i, [float(a) for a in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_index_equals_plain_search(spark, tmp_out, metric):
    rows = _clustered(3000, 3)
    rows += [(10_000 + i, rows[7][1]) for i in range(1500)]                    # a third of all rows are copies
    rows += [(20_000, None), (20_001, [1.0, 2.0]), (20_002, [1.0, 2.0]), (20_003, [0.0] * 8), (20_004, [])]
    queries = [(i, rows[i][1]) for i in range(0, 3000, 60)]
    queries += [(9000, [1.0, 2.5]), (9001, rows[7][1]), (9002, [100.0] * 8), (9003, [1.0] * 3), (9004, None), (9005, [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    index = vector_index.build(v, f"{tmp_out}/index", metric=metric)
    want = _rows(R.vector_top_k(q, v, k=5, metric=metric), ["query_id", "rank", "vec_id"])
    assert _rows(vector_index.search(q, index, k=5), ["query_id", "rank", "vec_id"]) == want


def test_vector_index_skips_most_blocks_of_clustered_vectors(spark, tmp_out):
    rows = _clustered(6000, 4)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, x) for i, x in rows if i % 20 == 0], "query_id int, embedding array<float>")
    index = vector_index.build(v, f"{tmp_out}/index")
    compared = [r["compared"] for r in vector_index.work(q, index, k=3).collect()]
    assert len(compared) == 300 and sum(compared) < 0.25 * 6000 * 300
