"""Removed words against a table of all 50-word windows; symbols of equal windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from ledgerline.llm import substring_dedup as S


def slow(rows, n=S.LENGTH):
    bodies = [(S.LAST if d is None else d, re.findall(r"[^ \t-\r]+", t or "")) for d, t in rows]
    least = {}
    for d, w in bodies:
        for p in range(len(w) - n + 1):
            k = tuple(w[p:p + n])
            least[k] = min(least.get(k, d), d)
    out = []
    for (d, w), (i, _) in zip(bodies, rows):
        gone = set()
        for p in range(len(w) - n + 1):
            if least[tuple(w[p:p + n])] < d:
                gone |= set(range(p, p + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "é", "the", "x y", "of"] if seed % 2 else [f"w{i}" for i in range(300)]

    def words(k):
        return [r.choice(vocabulary) for _ in range(k)]
    passages = [words(k) for k in (49, 50, 51, 60, 120, 400)]
    passages += [["a"] * 49, ["a"] * 50, ["the"] * 130, ["a", "b"] * 60, ["a", "b", "b"] * 40, ["a"] * 30 + ["b"] * 40,
                 (["a"] * 7 + ["b"] * 5) * 12]
    rows = []
    for i in range(n):
        t = words(r.choice([0, 10, 60, 300]))
        for _ in range(r.randint(0, 3)):
            at, p = r.randint(0, len(t)), list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "Z"
            t[at:at] = p
        rows.append((3 * i, "".join(w + r.choice([" ", "\n", " \t"]) for w in t)))
    rows += [(1000 - i, rows[i][1]) for i in range(8)]
    rows += [(2000, "a " * 500), (2001, "a " * 501), (2002, "b a " * 300), (2003, " ".join(["a"] * 49)), (None, rows[3][1]), (None, "q " * 150),
             (2004, None), (2005, ""), (2006, " \t\n"), rows[5], rows[5], (15, " ".join(words(80)) + " " + rows[5][1]),
             (2007, "x" * 50_000 + " " + rows[5][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    got = S.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows)


def test_segments_and_blocks(spark, monkeypatch):
    """Small segments, blocks and text steps change nothing (the functions run in this process)."""
    rows = rows_of(4)
    rows.append((5000, " ".join(t or "" for _, t in rows[:20])))
    for k, v in {"SEGMENT": 70, "BLOCK_WORDS": 300, "TEXT_STEP": 50, "KNOWN_WORDS": 3}.items():
        monkeypatch.setattr(S, k, v)
    known = S.Known()
    seen = {}
    for i, (_, t) in enumerate(rows):
        words = S.fingerprints(t or "", known)
        assert len(words) == len((t or "").replace(" ", "_").split())
        got = {}
        for block in S.blocks([t], [None], known):
            _, a, b, start = S.windows_of(block)
            got |= dict(zip(start.tolist(), zip(a.tolist(), b.tolist())))
            row, seed, _, _, first, n = S.seeds_of(block, 3, False)
            for s, f, k in zip(seed.tolist(), first.tolist(), n.tolist()):
                for p in range(f, f + k):
                    seen.setdefault(tuple(words[p:p + S.LENGTH].tolist()), set()).add(s)
        assert sorted(got) == list(range(max(len(words) - S.LENGTH + 1, 0)))
    assert all(len(s) == 1 for s in seen.values())


@pytest.mark.parametrize("top", [0, 1, 3, 5, 7])
def test_equal_windows_have_equal_symbols(top):
    """Whatever stands around: a window's symbol is a function of its words alone."""
    r = np.random.default_rng(top)
    for size in (2, 40, 3000):
        core = r.integers(1, size + 1, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        core[100:190] = core[100]
        core[250:340] = np.tile(core[250:253], 30)
        found = []
        for _ in range(6):
            around = [r.integers(1, size + 1, r.integers(0, 90)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2)]
            block = S.Block()
            block.add(0, 0, np.concatenate([around[0], core, around[1]]), None)
            _, seed, _, _, start, n = S.seeds_of(block, top, True)
            of = {int(p): int(s) for s, f, k in zip(seed, start, n) for p in range(f, f + k)}
            found.append([of[p + len(around[0])] for p in range(len(core) - S.LENGTH + 1)])
        assert all(f == found[0] for f in found)


def test_symbols_thin_out():
    """Prose of 5,000 words of vocabulary: one run of windows stands for many."""
    r = np.random.default_rng(5)
    block = S.Block()
    block.add(0, 0, r.integers(1, 1 << 62, 5000).astype(np.uint64)[r.integers(0, 5000, 100_000)], None)
    n = S.seeds_of(block, S.ROUNDS[0], False)[5]
    assert n.mean() > 10


def test_odd_tables(spark):
    """Empty table, extra columns with clashing names."""
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "w " * 60, 1, 2, 3, 4), (2, "v " + "w " * 60, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int, row int, gone int, live int")
    assert [tuple(r)[:3] for r in S.digest(df).orderBy("doc_id").collect()] == [(1, 60, 0), (2, 61, 60)]
