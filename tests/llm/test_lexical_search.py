"""Ranked search against a plain loop over all documents and items; slices, owners, item blocks, both index forms."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerline.llm import lexical_search as L


def terms_of(t):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in found]


def slow(docs, items, k=20):
    bodies = [(L.LAST if d is None else d, Counter(terms_of(t))) for d, t in docs]
    n, total = sum(1 for _, c in bodies if c), sum(sum(c.values()) for _, c in bodies)
    df = Counter(w for _, c in bodies for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in bodies:
            s = 0
            if c:
                m = 75 + 25 * sum(c.values()) * n // total
                for w in terms_of(text):
                    if c[w]:
                        s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m))
            if s > 0:
                found.append((-s, d))
        out += [(item, i + 1, None if d == L.LAST else d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows_of(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Wort", "é", "x1", "日本", "o'Neil") for b in range(40)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([0, 3, 30, 300])))) for i in range(n)]
    docs += [(900, None), (901, ""), (902, "...!"), (None, docs[5][1]), docs[9], docs[9], (903, "wort0 " * 5000 + "y" * 100_000)]
    docs += [(1000 + i, "Wort150 x12") for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=12))) for i in range(30)]
    return docs, items + [(40, None), (41, ""), (42, "unheard of"), (43, "wort150 wort150 x12"), (None, items[3][1]), items[4], items[4], (44, "WORT0 Wort0")]


@pytest.mark.parametrize("sizes", [{}, {"TERM_BYTES": 0, "ITEM_BLOCK": 7}])
def test_against_loop(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(L, name, value)
    docs, items = rows_of(len(sizes))
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(docs, items)


def test_slices_are_bounded(monkeypatch):
    """A slice is closed by documents or by terms; parts of a long text count once (this process)."""
    monkeypatch.setattr(L, "SLICE_TERMS", 50)
    from ledgerline.llm import term_bytes
    monkeypatch.setattr(term_bytes, "STEP", 64)
    s = L.Slice(None)
    s.add(7, "ab Cd ab " * 400)
    assert s.full()
    rows = s.batch(3).to_pylist()
    assert rows[0] == {"slice": 3, "term": None, "places": [0], "counts": [1200], "ids": [7]}
    assert {r["term"]: (r["places"], r["counts"]) for r in rows[1:]} == {b"ab": ([0], [800]), b"cd": ([0], [400])}


def test_pruning_keeps_the_best(spark):
    """Many documents of one common term beside few of a rare one: the result holds both in order."""
    docs = [(i, "common " * (1 + i % 7) + "pad " * (i % 50)) for i in range(6000)] + [(9000 + i, "rare " + "pad " * i) for i in range(5)]
    items = [(1, "rare common"), (2, "common"), (3, "pad common rare")]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(docs, items)


def test_odd_tables(spark):
    none, some = "doc_id long, text string", spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, item int, slice int, score int")
    items = spark.createDataFrame([(1, "a", 2, 3)], "item_id long, text string, rank int, term int")
    assert L.search(spark.createDataFrame([], none), items).collect() == []
    assert L.search(some, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert [tuple(r)[:3] for r in L.search(some, items).collect()] == [(1, 1, 1)]
