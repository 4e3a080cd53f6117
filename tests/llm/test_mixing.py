"""Cube-method mixing: targets against the stepwise rule, balance, bounds, reruns."""

import random
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import mixing as M

SF = "/root/testdata/sf0.01"


def slow_targets(sizes):
    """The rule as stated: share by weight, stop at 3 times, reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        unit = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * unit > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else w[s] * unit for s in names}
        capped |= over


def check(rows, tolerance_docs=2):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[0]] += r[1]["size"]
    want = slow_targets(sizes)
    taken, biggest = defaultdict(int), defaultdict(int)
    for s, r in rows:
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken % max(r["size"], 1) == 0 and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance_docs * biggest[s] + 1e-6


def test_flight_balance():
    r = random.Random(5)
    for _ in range(20):
        size = [float(r.choice([0, 1, 5, 5, 90, 1000])) for _ in range(200)]
        p = [r.random() for _ in size]
        q = M.flight(size, p, r)
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(q) == pytest.approx(sum(p), abs=1e-4)
        assert sum(a * x for a, x in zip(size, q)) == pytest.approx(sum(a * x for a, x in zip(size, p)), rel=1e-6)
        assert all(x in (0, 1) for x in M.flight(size, p, r, land=True))


def test_unbiased():
    hits = Counter()
    for k in range(3000):
        q = M.flight([3.0, 8.0, 8.0, 1.0], [0.2, 0.5, 0.7, 0.9], random.Random(k), land=True)
        hits.update(i for i, x in enumerate(q) if x)
    assert [hits[i] / 3000 for i in range(4)] == pytest.approx([0.2, 0.5, 0.7, 0.9], abs=0.04)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    got = M.digest(docs, block=32).collect()
    check([(src[r.doc_id], r) for r in got])
    assert sorted(r.doc_id for r in got) == sorted(src)
    again = M.digest(docs.repartition(5), block=32).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    mix = M.mixed(docs, block=32)
    assert mix.columns == docs.columns
    assert sum(r.taken for r in got) == pytest.approx(sum(len(r.text.split()) for r in mix.collect()), rel=0.02)


def test_edges(spark):
    rows = ([(i, "w " * (i % 7), "a", 0) for i in range(40)] + [(5, "x y z", None, 1)] * 9
            + [(None, None, None, 2), (None, "", "empty", 3), (1, "one", "B", 4)])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _m0 int")
    out = M.digest(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _x in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    assert {round(r.target, 6) for r in out} == {round(want[s], 6) for s in want}
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert M.mixed(df).columns == df.columns and M.mixed(df).count() > 0
    assert M.digest(df.limit(0)).count() == 0 and M.mixed(df.limit(0)).count() == 0
