"""CRC matrices against zlib, the draw against a plain loop, the noise's law."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ledgerline.llm import importance_resample as I


def fold(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, target, ngram=1, buckets=I.BUCKETS, min_words=20, percent=10):
    def features(t):
        w = fold(t)
        return [" ".join(w[i:i + k]) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, x in docs:
        fs = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(fold(x))])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], I.LAST if r[0] is None else r[0], r[1], r[2]))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(seed, n=200):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Wort", "é", "x1", "日本", "o'Neil") for b in range(30)]
    rows = [(i, r.choice([" ", "\n", "-", "\x00"]).join(r.choice(vocabulary) for _ in range(r.choice([0, 5, 19, 20, 21, 200])))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "..."), (None, rows[7][1] + " z" * 30), rows[7], rows[7], (903, "y" * 5000 + " q" * 25), (904, "y" * 200_000)]
    return rows, [" ".join(r.choice(vocabulary[:40]) for _ in range(30)) for _ in range(10)] + [None, ""]


@pytest.mark.parametrize("ngram,buckets,percent", [(1, I.BUCKETS, 10), (2, 97, 50), (3, 1000, 100)])
def test_against_loop(spark, ngram, buckets, percent):
    rows, target = rows_of(ngram)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = I.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), ngram, buckets, percent=percent)
    assert (sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
            == slow(rows, target, ngram, buckets, percent=percent))


def test_crc_matrices():
    r = random.Random(3)
    features = [r.randbytes(n) for n in [1, 1, 2, 7, 7, 7, 300, I.PART - 1, I.PART, I.PART + 1, 5 * I.PART, 5 * I.PART + 3, 100_000]]
    assert I.crc32s(features).tolist() == [zlib.crc32(f) for f in features]
    assert I.crc32s([]).tolist() == []


def test_odd_tables(spark):
    """Empty tables on either side; extra columns with clashing names."""
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "a b " * 20, 1, 2, 3) for i in range(30)], "doc_id long, text string, rank int, bucket int, id int")
    assert I.digest(none, none).collect() == [] and I.digest(none, some).collect() == []
    got = I.digest(some, none).collect()
    assert len(got) == 30 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
