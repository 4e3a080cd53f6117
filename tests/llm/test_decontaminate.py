"""Leaks against a brute-force comparison of every window with every item."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerline.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def grams(w, k):
    return Counter(" ".join(w[i:i + k]) for i in range(len(w) - k + 1))


def slow(docs, items, t=0.8):
    out = []
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v or len(w) < len(v):
                continue
            k = min(5, len(v))
            g, best = grams(v, k), None
            m = sum(g.values())
            for s in range(len(w) - len(v) + 1):
                common = sum((g & grams(w[s:s + len(v)], k)).values())
                sim = common / (2 * m - common)
                if sim >= t - 1e-12 and (best is None or sim > best[1] + 1e-12):
                    best = (s, sim)
            if best:
                out.append((d, i, best[0], round(best[1], 9)))
    return sorted(out, key=repr)


def test_stride_is_safe():
    for m in range(1, 200):
        common = next(c for c in range(m + 1) if c / (2 * m - c) >= 0.8 - 1e-12)
        assert m // D.stride(m) > m - common


def planted(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 9, 15, 22, 40, 60])))) for i in range(24)]
    items += [(99, "a a a a a a a a b a a a a a a a"), (None, items[0][1]), (50, None), (51, "  ")]
    docs = []
    for d in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 2)):
            v = r.choice(items)[1]
            v = (v or "").split()
            for _ in range(r.randint(0, 3)):
                if v:
                    j = r.randrange(len(v))
                    v[j:j + 1] = r.choice([[], ["zz"], [v[j].upper()], [v[j], "qq"]])
            at = r.randint(0, len(w))
            w[at:at] = v
        docs.append((d, " ".join(w)))
    return docs + [docs[0], docs[1], (None, docs[2][1]), (7, None), (8, "")], items


def test_against_brute_force(spark):
    docs, items = planted(1)
    got = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                  spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.item_id, r.position, round(r.similarity, 9)) for r in got), key=repr) == slow(docs, items)
    assert all(r.distance <= D.RADIUS for r in got)


def test_lookup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "LOOKUP", 150)
    docs, items = planted(3, 25)
    items = [x for x in items if len((x[1] or "").split()) > 5]
    got = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                  spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.item_id, r.position, round(r.similarity, 9)) for r in got), key=repr) == slow(docs, items)


def test_clean(spark):
    docs, items = planted(4, 30)
    items = [x for x in items if len((x[1] or "").split()) != 3]
    df = spark.createDataFrame([(d, t, 1, None) for d, t in docs], "doc_id bigint, text string, _c0 int, w string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = D.clean(df, bench)
    bad = {docs[r[0]][1] for r in slow(list(enumerate(t for _, t in docs)), items)}
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r for r in docs if r[1] not in bad)
    assert D.leaks(df.limit(0), bench).count() == 0
    assert D.clean(df, bench.limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = D.leaks(df, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_whole(docs, items, t=0.8):
    """As ``slow``, and a document shorter than the item is one window."""
    out = []
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v or not w:
                continue
            k = min(5, len(v))
            g, best = grams(v, k), None
            for s in range(max(len(w) - len(v), 0) + 1):
                x = grams(w[s:s + len(v)], k)
                common = sum((g & x).values())
                sim = common / (sum(g.values()) + sum(x.values()) - common)
                if sim >= t - 1e-12 and (best is None or sim > best[1] + 1e-12):
                    best = (s, sim)
            if best:
                out.append((d, i, best[0], round(best[1], 9)))
    return sorted(out, key=repr)


def test_stride_is_safe_for_short_documents():
    for m in range(1, 200):
        for own in range(1, m + 1):
            common = next((c for c in range(own + 1) if c / (m + own - c) >= 0.8 - 1e-12), None)
            if common is not None:
                assert -(-own // D.stride(m)) > own - common


def test_documents_shorter_than_the_item(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([3, 5, 6, 12, 20, 33, 47, 59, 59, 80, 120])]
    items += [(50, "a a a a a a a a b a a a a a a a a a"), (51, None)]
    docs = [(0, " ".join(items[7][1].split()[:-5]))]
    for i, item in items[:-1]:
        for _ in range(8):
            v = item.split()
            a, b = r.randint(0, max(1, len(v) // 6)), r.randint(0, max(1, len(v) // 6))
            v = v[a:len(v) - b]
            if v and r.random() < 0.4:
                j = r.randrange(len(v))
                v[j:j + 1] = r.choice([[], ["zz"], [v[j].upper()]])
            docs.append((len(docs), " ".join(v)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = slow_whole(docs, items)
    got = D.leaks(df, bench).collect()
    assert sorted(((x.doc_id, x.item_id, x.position, round(x.similarity, 9)) for x in got), key=repr) == want
    assert (0, 7, 0, round(50 / 55, 9)) in want and len(want) > len(slow(docs, items)) + 10
    assert {x.doc_id for x in D.clean(df, bench).collect()} == {d for d, _ in docs} - {x[0] for x in want}


def test_fingerprints_of_very_long_windows(spark):
    """More than 65,535 equal shingles: the counters hold, the fingerprint is the shingle's hash."""
    rows = spark.createDataFrame([(1, "tick " * 70_000), (2, "tick " * 20)], "id long, text string").selectExpr(
        "id", "split(trim(text), ' ') AS w", "size(split(trim(text), ' ')) - 4 AS m")
    prints = {r["id"]: r["fp"] for r in D._fingerprints(rows, ["id"], "w", 5).collect()}
    assert prints[1] == prints[2] == spark.sql("SELECT xxhash64('tick', 'tick', 'tick', 'tick', 'tick')").first()[0]


def test_windows_meet_only_items_that_share_an_anchor(spark):
    """2,000 items of one length: candidate pairs follow the shared passages, not windows times items."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(30))) for i in range(2000)]
    docs = [(d, " ".join([*(r.choice(vocab) for _ in range(40)), items[d * 7][1], *(r.choice(vocab) for _ in range(40))])) for d in range(100)]
    own = D.stored(D._items(spark.createDataFrame(items, "item_id bigint, text string")).select("ik", "len", "m", "w"))
    places = own.select("len", "m", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: D._shingle_hash(F.col("w"), i, 5))).alias("hash")).distinct()
    c1, c2 = D.content_key(F.col("text"))
    keyed = spark.createDataFrame(docs, "doc_id bigint, text string").select(c1.alias("c1"), c2.alias("c2"), D.words(F.lower("text")).alias("w"))
    listed = [x["hash"] for x in places.select("hash").distinct().collect()]
    anchors = D.stored(D._anchors(keyed, places, 5, D.stride(26), listed, D.SIMILARITY))
    win = D.stored(D._windows(anchors, 5))
    blocks = D._blocks(D.RADIUS)
    pairs = D._candidates(win, anchors, D._index(own, 5, blocks), 5, blocks).select(*D.WINDOW_ID, "ik").distinct().count()
    windows = win.count()
    assert windows > 2500 and pairs <= windows      # the cross product has 2,000 items for each window
    got = D.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(d, d * 7) for d in range(100)}
