"""The pipeline's stages against brute-force versions on the smallest tables."""

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from test_decontaminate import slow as slow_leaks
from test_mixing import slow_targets
from test_simhash_dedup import slow_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, f in P.STAGES:
        docs = f(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_stages(spark, steps):
    first, lang, dedup, clean, mix, shards = steps
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    # every document with letters has a language here
    assert sorted(r.doc_id for r in lang) == sorted(r.doc_id for r in first if any(c.isalpha() for c in r.text))
    classes = slow_classes([(r.doc_id, r.text) for r in lang])
    assert sorted(r.doc_id for r in dedup) == sorted({c for _, _, c in classes})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in slow_leaks([(r.doc_id, r.text) for r in dedup], items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in dedup if r.doc_id not in bad)
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += len(r.text.split())
        biggest[r.source] = max(biggest[r.source], len(r.text.split()))
    for r in mix:
        taken[r.source] += len(r.text.split())
    want = slow_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 2 * biggest[s] for s in sizes)
    assert max(Counter(r.doc_id for r in mix).values()) <= 3
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in mix)
    counts = Counter(r.shard for r in shards)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1


def test_columns(steps):
    assert all(set(r.asDict()) == set(steps[0][0].asDict()) for rows in steps[:5] for r in rows[:1])
    assert set(steps[5][0].asDict()) == {*steps[0][0].asDict(), "shard", "slot"}


def test_run(spark, steps):
    assert "pipeline" in E.queries() and "pipeline" not in E.oracle_sql()
    got = E.queries()["pipeline"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in steps[5])


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the end of it", "en", "a", 13),
            (2, "the end of it", "en", "a", 13), (3, "der Hund und die Katze", "de", None, 22)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, f in P.STAGES:
            docs = f(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
        assert {r.doc_id for r in docs.collect()} <= {2, 3}


def test_hostile_columns(spark):
    """Columns named like the helpers' own, a map, an array and a struct with a map: every stage keeps them as they are."""
    names = ["_block", "_block0", "_r0", "_r1", "_s0", "_k0", "_m0", "_c0", "n", "bucket", "row", "place", "rec", "first", "total", "a", "b",
             "copy", "size", "target", "times", "fp", "id", "w", "m"]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, tags map<string,int>, deep array<struct<x:map<string,int>>>, " + \
        ", ".join(f"`{c}` string" for c in names)
    texts = ["the end of the first of them", "der Hund und die Katze im Haus", "the end of another story told", None, ""]
    rows = [(i, t, "en" if i != 1 else "de", "ab"[i % 2], i, {"k": i}, [({"z": i},)], *[f"mine {c}" for c in names]) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (9, None, None, None, None, None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, kind)
    before = docs.columns
    for name, f in P.STAGES:
        docs = f(spark, docs, SF)
        assert docs.columns == before + ["shard", "slot"] * (name == "shard"), name
        got = docs.collect()
        assert got, name
        for r in got:
            assert r.tags == {"k": r.doc_id} and r.deep[0].x == {"z": r.doc_id} and all(r[c] == f"mine {c}" for c in names), name
        docs = spark.createDataFrame(got, docs.schema)


def test_no_language_learned(spark):
    """With null languages throughout nothing can be learned: rows with a letter pass, the others go."""
    docs = spark.createDataFrame([(1, "some words"), (2, "1234 ..."), (3, None), (4, "日本"), (5, "")],
                                 "doc_id bigint, text string").selectExpr("*", "CAST(NULL AS string) AS lang", "'s' AS source", "1L AS n_chars")
    assert sorted(r.doc_id for r in P.language_stage(spark, docs, SF).collect()) == [1, 4]


def test_mixed_languages_stay(spark):
    """A text in four languages in even shares is no reason to drop it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [r.text for lang in ("en", "de", "fr", "es") for r in docs.where(f"lang = '{lang}' AND length(text) > 300").orderBy("doc_id").limit(1).collect()]
    mixed = " ".join(" ".join(p.split()[:40]) for p in parts)
    more = spark.createDataFrame([(10**9, mixed, None, "x", len(mixed))], docs.schema)
    kept = P.language_stage(spark, docs.unionByName(more), SF)
    assert len(parts) == 4 and kept.where("doc_id = 1000000000").count() == 1
