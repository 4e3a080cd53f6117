import math
import re

import pytest

from pyspark.sql import functions as F

from ledgerline.operators import retrieval as R


def test_vector_top_k_ties_and_small_collection(spark):
    vecs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in sorted(R.vector_top_k(q, vecs, k=5).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 1), (2, 3), (3, 2)]  # equal distances: lower id first; k > count gives count


def test_vector_top_k_empty_collection_raises(spark):
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0])], "query_id int, embedding array<float>")
    with pytest.raises(RuntimeError):
        R.vector_top_k(q, vecs)


def test_vector_top_k_matches_brute_force(spark, tables):
    e = tables.raw("embeddings").collect()
    queries = [(i, e[i * 37]["embedding"]) for i in range(4)]
    qdf = spark.createDataFrame(queries, "query_id int, embedding array<float>")
    got = {}
    for r in R.vector_top_k(qdf, tables.raw("embeddings"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for qi, qv in queries:
        d = sorted((round(sum((float(a) - float(b)) ** 2 for a, b in zip(qv, row["embedding"])), 9), row["vec_id"])
                   for row in e)
        assert [v for _, v in sorted(got[qi])] == [vid for _, vid in d[:3]]


def _bm25_brute(queries, chunks, k=3, k1=1.2, b=0.75):
    tok = {cid: [t for t in re.split(r"[^\w]+|_", text.lower()) if t] for cid, text in chunks}
    n = len(tok)
    avgdl = sum(len(v) for v in tok.values()) / n
    out = {}
    for qid, qtext in queries:
        terms = {t for t in re.split(r"[^\w]+|_", qtext.lower()) if t}
        scores = {}
        for cid, toks in tok.items():
            s = 0.0
            for t in terms:
                tf = toks.count(t)
                if tf:
                    df = sum(1 for v in tok.values() if t in v)
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    s += idf * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * len(toks) / avgdl))
            if s > 0:
                scores[cid] = round(s, 9)
        out[qid] = [c for c, _ in sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))[:k]]
    return out


def test_text_top_k_matches_brute_force(spark):
    chunks = [("a", "the cat sat on the mat"), ("b", "the dog ate the cat food"), ("c", "a bird sang"),
              ("d", "cats and dogs and birds"), ("e", "the the the cat")]
    queries = [(1, "cat mat"), (2, "dog food"), (3, "bird")]
    cdf = spark.createDataFrame(chunks, "id string, text string")
    qdf = spark.createDataFrame(queries, "query_id int, text string")
    got = {}
    for r in R.text_top_k(qdf, cdf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = _bm25_brute(queries, chunks)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


def test_context_and_sources(spark):
    chunks = spark.createDataFrame([("x_p1_c1", "x.pdf", 1, "alpha"), ("x_p1_c2", "x.pdf", 1, "beta"),
                                    ("y_p2_c1", "y.pdf", 2, "gamma")], "id string, source string, page int, text string")
    hits = spark.createDataFrame([(1, 2, "x_p1_c1"), (1, 1, "y_p2_c1"), (1, 3, "x_p1_c2")],
                                 "query_id int, rank int, id string")
    ctx = R.build_context(hits, chunks).first()["context"]
    assert ctx == ("Source: y.pdf, page 2\nText: gamma\n\nSource: x.pdf, page 1\nText: alpha\n\n"
                   "Source: x.pdf, page 1\nText: beta")
    assert R.source_list(hits, chunks).first()["sources"] == "y.pdf (page 2); x.pdf (page 1)"


def test_index_upsert_keeps_stale_chunks(spark):
    old = spark.createDataFrame([("d_p1_c1", "d.pdf", 1, 1, "old1"), ("d_p1_c2", "d.pdf", 1, 2, "old2"),
                                 ("e_p1_c1", "e.pdf", 1, 1, "e")], "id string, source string, page int, chunk int, text string")
    new = spark.createDataFrame([("d_p1_c1", "d.pdf", 1, 1, "new1")], "id string, source string, page int, chunk int, text string")
    got = {r["id"]: r["text"] for r in R.index_upsert(old, new).collect()}
    assert got == {"d_p1_c1": "new1", "d_p1_c2": "old2", "e_p1_c1": "e"}
    got2 = {r["id"]: r["text"] for r in R.index_upsert(old, new, replace_sources=True).collect()}
    assert got2 == {"d_p1_c1": "new1", "e_p1_c1": "e"}


def test_distance_matrices_are_bounded(monkeypatch):
    """However many queries a block holds, a matrix holds DISTANCE_CELLS pairs at most; a task's best merge over batches."""
    import numpy as np
    r, seen, whole = np.random.default_rng(4), [], R._distances
    q, v, ids = r.integers(0, 4, (700, 3)).astype(float), r.integers(0, 4, (300, 3)).astype(float), r.permutation(300)
    d = whole("l2", q, v)
    want = np.array([[i for _, i in sorted(zip(row, ids))[:5]] for row in d])
    monkeypatch.setattr(R, "DISTANCE_CELLS", 6000)
    monkeypatch.setattr(R, "_distances", lambda m, a, b: (seen.append(len(a) * len(b)), whole(m, a, b))[1])
    near, far = (R._k_nearest("l2", q, ids[s], v[s], 5) for s in (slice(0, 120), slice(120, 300)))
    got, _ = R._best(*(np.concatenate(x, axis=1) for x in zip(near, far)), 5)
    assert max(seen) <= 6000 and (got == want).all()


def test_pages_of_one_source_spread(spark):
    """The pages of a large source, with their texts, are numbered in several tasks."""
    docs = spark.range(12_000).selectExpr("'a' AS source", "id AS doc_id", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in R.page_text(docs).groupBy(F.spark_partition_id()).count().collect()]
        pages = R.page_text(docs).agg(F.min("page"), F.max("page"), F.count_distinct("page")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 12_000 and tuple(pages) == (1, 12_000, 12_000)
