"""Chunk dedup against a brute-force version that keeps every chunk's text."""

import random
from struct import pack

from xxhash import xxh64_intdigest

from ledgerline.llm import line_dedup as D

SF = "/root/testdata/sf0.001"


def h(x, seed=42):
    v = xxh64_intdigest(x.encode() if isinstance(x, str) else pack("<q", x), seed)
    return v - (1 << 64) if v >> 63 else v


def chunks(text):
    lines = text.split("\n")
    hs = [h(x) for x in lines]
    out, at = [], 0
    for i in range(1, len(lines) + 1):
        r = 42
        for k in range(D.WINDOW, 0, -1):
            if i - k >= 0:
                r = h(hs[i - k], r & (1 << 64) - 1)
        if i == len(lines) or r % D.DIVISOR == 0:
            if i - at >= D.MIN_LINES:
                out.append((at, i - at, "\n".join(lines[at:i])))
            at = i
    return out


def slow(rows):
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = set(), {}
    for r in order:
        for at, n, t in chunks(r[1]):
            if t in seen:
                gone.setdefault(r, set()).update(range(at, at + n))
            seen.add(t)
    out = []
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        bad = gone.get(r, set())
        out.append((r[0], r[1] if not bad else "\n".join(x for i, x in enumerate(lines) if i not in bad), len(lines), len(bad)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(7)
    passages = [[f"line {r.randrange(60)}" for _ in range(r.randint(2, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {j}" for j in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(lines))
            lines[at:at] = r.choice(passages)
        rows.append((i, "\n".join(lines)))
    rows += [rows[3], rows[4], (500, rows[5][1]), (None, rows[6][1]), (600, None), (601, ""), (602, "\n\n\n"), (603, "one")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, k1 int")
    got = sorted(map(tuple, D.dedup(df).collect()), key=repr)
    assert got == slow(rows)
    assert sum(x[3] for x in got) > 50
    assert D.dedup(df.limit(0)).count() == 0


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = D.dedup(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(map(tuple, out.collect()), key=repr) == slow([(x.doc_id, x.text) for x in df.collect()])


def slow_runs(rows):
    """Every run of two and more lines that stands earlier, by comparing runs of every length at every place."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = {}, {}
    for d, r in enumerate(order):
        lines = r[1].split("\n")
        for n in range(D.MIN_LINES, len(lines) + 1):
            for i in range(len(lines) - n + 1):
                if not all(any(x.strip() for x in lines[j:j + 2]) for j in range(i, i + n - 1)):
                    continue
                at = seen.setdefault(tuple(lines[i:i + n]), (d, i))
                if at[0] < d or at[1] + n <= i:
                    gone.setdefault(r, set()).update(range(i, i + n))
    out = []
    for r in rows:
        lines, bad = [] if r[1] is None else r[1].split("\n"), gone.get(r, set())
        out.append((r[0], r[1] if not bad else "\n".join(x for i, x in enumerate(lines) if i not in bad), len(lines), len(bad)))
    return sorted(out, key=repr)


def test_runs_against_brute_force(spark):
    r = random.Random(11)
    passages = [[f"p {k} {j}" for j in range(r.randint(2, 12))] for k in range(8)] + [["a", "", "b", "a", "", "b"], ["x"] * 7]
    rows = []
    for i in range(50):
        lines = [r.choice([f"own {i} {j}", "", "often"]) for j in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 3)):
            at, p = r.randint(0, len(lines)), r.choice(passages)
            a = r.randrange(len(p))
            lines[at:at] = p[a:] if r.random() < 0.3 else p
        rows.append((i, "\n".join(lines)))
    rows += [rows[3], rows[4], (500, rows[5][1]), (None, rows[6][1]), (600, None), (601, ""), (602, "\n\n\n"), (603, "one")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, k1 int")
    assert sorted(map(tuple, D.dedup_runs(df).collect()), key=repr) == slow_runs(rows)
    assert D.dedup_runs(df.limit(0)).count() == 0


def test_every_planted_passage_goes(spark):
    """Passages of 2 to 12 lines, each in two documents with other surroundings: the second copy goes as a whole."""
    from ledgerline.llm import queries
    rows = []
    for k in range(200):
        passage = [f"passage {k} line {j}" for j in range(2 + k % 11)]
        rows += [(2 * k + c, "\n".join([f"before {k} {c}", *passage, f"after {k} {c}"])) for c in (0, 1)]
    import tempfile
    sf = tempfile.mkdtemp(prefix="ledgerline-tests-")
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{sf}/documents.parquet")
    got = {x.doc_id: x.n_removed for x in queries.op9_line_dedup(spark, sf).collect()}
    assert got == {2 * k + c: c * (2 + k % 11) for k in range(200) for c in (0, 1)}
    plan = queries.op9_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
