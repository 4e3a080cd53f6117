"""SimHash near-duplicates against a brute-force join of all fingerprints."""

import random

import numpy as np
import xxhash

from ledgerline.llm import simhash_dedup as S

SF = "/root/testdata/sf0.001"


def slow_print(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
             .replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows, budget=2):
    prints = [slow_print(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return sorted(((d, f"{p:016x}", best.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def random_rows(n, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice("ab cd Ef gh ij kl mn\top qr é ß".split()) for _ in range(r.randint(0, 60))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = r.choice(base).split(" ")
        if t and r.random() < 0.5:
            t[r.randrange(len(t))] = r.choice(["ZZ", "é", "", "\n"])
        rows.append((r.randrange(10 * n), " ".join(t)))
    return rows + [(None, rows[0][1]), (None, None), (5, ""), (6, None), rows[1], rows[1], (None, "only this text")]


def test_fingerprint():
    for _, t in random_rows(80, 1):
        assert S.fingerprint(None if t is None else t.encode()) == slow_print(t)


def test_trie_links():
    r = np.random.default_rng(3)
    v = np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64))
    v = np.unique(np.concatenate([v, v ^ np.uint64(1 << 40), v[:50] ^ np.uint64((1 << 63) | 1)]))
    label = S.trie_links(v, len(v), 2)
    up = np.arange(len(v))
    for i in range(len(v)):
        for j in range(i):
            if int(v[i] ^ v[j]).bit_count() <= 2:
                up = np.where(up == max(up[i], up[j]), min(up[i], up[j]), up)
    assert {frozenset(np.flatnonzero(label == x)) for x in set(label)} == {frozenset(np.flatnonzero(up == x)) for x in set(up)}


def test_against_brute_force(spark):
    for seed, cap in ((1, 4096), (2, 4)):
        rows = random_rows(160, seed)
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted(map(tuple, S.near_duplicates(df, min_subtrie=cap).collect()), key=repr)
        assert got == slow_classes(rows)


def test_small_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, S.near_duplicates(df, min_subtrie=16).collect()), key=repr)
    assert got == slow_classes([tuple(r) for r in df.collect()])


def test_keep_one(spark):
    texts = [t for _, t in random_rows(60, 4)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, d, None) for d, t in rows] + [(900, "a b c d", 1, None)] * 3
                               + [(None, "u v w x", 2, None)], "doc_id bigint, text string, _k0 int, fp string")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in slow_classes([*rows, (900, "a b c d"), (None, "u v w x")])}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0
