"""Linear-chain CRF: marginals against enumeration, held-out accuracy, labels of mixed texts, edge rows."""

import itertools
import random

import numpy as np
import pytest

from ledgerline.llm import language_id as L

SF = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    move = r.normal(size=(3, 3))
    lengths = np.array([1, 5, 3])
    scores = r.normal(size=(9, 3)).astype(np.float32)
    old, L.SEGMENT = L.SEGMENT, 2
    try:
        got = L.marginals(scores, lengths, move)
    finally:
        L.SEGMENT = old
    at = 0
    for n in lengths:
        s = scores[at:at + n]
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            start = np.log(np.exp(move).sum(axis=0))[path[0]]
            w = np.exp(start + sum(s[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += w
        assert np.allclose(got[at:at + n], p / p.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark.read.parquet(f"{SF}/documents.parquet"), per_language=60)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs, model).where(L.held_out(L.F.col("doc_id"))).collect()
    assert len(rows) > 200
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_contract_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from zlib import crc32
    got = L.digest(docs).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_words_of_mixed_text(spark, model):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").where(L.held_out(L.F.col("doc_id"))).collect()
            if len(L.letter_runs(r.text)) > 80]
    rng = random.Random(2)
    rows, gold = [], {}
    for i in range(40):
        text, want = [], []
        for _ in range(4):
            d = rng.choice(docs)
            w = L.letter_runs(d.text)
            j = rng.randrange(len(w) - 30)
            text += w[j:j + 25]
            want += [d.lang] * 25
        rows.append((i, " ".join(text)))
        gold[i] = want
    got = L.label_words(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert len(got) == sum(map(len, gold.values()))
    assert np.mean([gold[r.doc_id][r.position] == r.lang for r in got]) > 0.95


def test_edges(spark, model):
    rows = [(None, None, "en", 1), (1, "", None, 2), (2, "123 !!! ___", "de", 3), (3, "the and of " * 40_000, "en", 4),
            (4, "x" * 200_000, "en", 5), (4, "x" * 200_000, "en", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score0 int")
    got = L.identify(df, model, words_by_language="mass").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0.0] * 3
    assert got[3].lang_pred == "en" and got[3].score > 0.9 and got[3].score0 == 4
    assert sum(got[3].mass.values()) == pytest.approx(120_000, rel=1e-3)
    assert got[4][4:] == got[5][4:]
    kept = L.accepted(df, model, "_p", "_s")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4}
    empty = df.limit(0)
    assert L.digest(empty).count() == 0
    assert [r.lang_pred for r in L.identify(df, L.train(empty)).collect()] == ["und"] * 6
