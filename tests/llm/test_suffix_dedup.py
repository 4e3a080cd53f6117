"""Removed bytes against a table of all 100-byte strings."""

import hashlib
import random

import numpy as np

from ledgerline.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def slow(rows, n=S.LENGTH):
    first = {}
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for d, b in bodies:
        o = S.LAST if d is None else d
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            first[w] = min(first.get(w, (o, p)), (o, p))
    out = []
    for d, b in bodies:
        o = S.LAST if d is None else d
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < (o, p):
                gone[p:p + n] = True
        g = gone[:len(b)]
        rest = np.frombuffer(b, np.uint8)[~g].tobytes()
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if len(g) else 0
        out.append((d, len(b), int(g.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n=50):
    r = random.Random(seed)
    def text(k):
        return "".join(r.choice("abc dé ") for _ in range(k))
    passages = [text(r.choice([90, 99, 100, 101, 130, 400])) for _ in range(8)]
    rows = []
    for i in range(n):
        t = text(r.choice([0, 50, 200, 600]))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(t))
            p = r.choice(passages)
            if r.random() < 0.4:
                j = r.randrange(len(p))
                p = p[:j] + "Z" + p[j:]
            t = t[:at] + p + t[at:]
        rows.append((3 * i, t))
    rows += [(1000 - i, rows[i][1]) for i in range(8)]
    rows += [(2000, "x" * 500), (2001, "xy" * 300), (2002, "y" + "x" * 130), (None, rows[3][1]), (None, "q" * 150), (2003, None),
             (2004, ""), (2005, "short"), rows[5], rows[5], (15, text(150) + rows[5][1]), (2006, "\0" * 240), (2007, "a" + "\0" * 110)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, k int, doc int").repartition(5)
        got = S.digest(df, buckets=3 + seed, kept=seed == 1).collect()
        assert sorted((tuple(x)[:5] for x in got), key=repr) == slow(rows)
        if seed == 1:
            assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)


def test_long_text_in_pieces(monkeypatch):
    rows = rows_of(3, 12)
    texts = [(t or "").encode() for _, t in rows] + [b"ab" * 4000, b"".join((t or "").encode() for _, t in rows)]
    whole = np.sort(np.concatenate(list(S.text_anchors(texts))))
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    assert np.array_equal(np.sort(np.concatenate(list(S.text_anchors(texts)))), whole)


def test_joined_by_document(spark, monkeypatch):
    monkeypatch.setattr(S, "SIDE_BYTES", -1)
    rows = rows_of(4, 20)
    got = S.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == slow(rows)


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, S.digest(df).collect()), key=repr) == slow([tuple(x) for x in df.collect()])


def test_empty(spark):
    assert S.digest(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
