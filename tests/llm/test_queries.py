"""Every registered query of the subpackage over the smallest tables: contract columns, row counts, oracles."""

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DOCUMENTS = "documents"
CONTRACT = {
    "op1_language_id": (DOCUMENTS, "doc_id held_out lang_pred score"),
    "op2_decontaminate": (None, "doc_id item_id position similarity distance"),
    "op3_sharding": (DOCUMENTS, "doc_id size text_crc32 law shard slot grown_shard"),
    "op4_suffix_dedup": (DOCUMENTS, "doc_id n_bytes n_removed n_spans kept_sha256"),
    "op5_license_scan": (None, "doc_id license position n_words reduction n_differences differences matched"),
    "op6_simhash_dedup": (DOCUMENTS, "doc_id fingerprint component_id"),
    "op7_quality_rules": (DOCUMENTS, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    "op8_mixing": (DOCUMENTS, "doc_id size source_size target taken"),
    "op9_line_dedup": (DOCUMENTS, "doc_id text n_lines n_removed"),
    "op10_html_extract": ("pages", "page_id url text n_chars"),
    "op11_substring_dedup": (DOCUMENTS, "doc_id n_words n_removed kept_sha256"),
    "op12_importance_resample": (DOCUMENTS, "doc_id n_features weight score rank"),
    "op13_lexical_search": (None, "item_id rank doc_id score"),
}


def test_registered():
    assert set(QUERIES) == set(CONTRACT) and set(QUERIES) <= set(E.queries())
    assert set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    source, columns = CONTRACT[name]
    df = QUERIES[name](spark, SF)
    assert set(columns.split()) <= set(df.columns)
    rows = df.collect()
    if source:
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        found = con.execute(ORACLES[name])
        cols = [c[0] for c in found.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "a", 0)] * 2
                                  + [(2, "word " * 3000 + "\n" + "x" * 200_000, None, None, None), (None, " \t", "en", "b", 2)]])
def test_odd_tables(spark, tmp_out, rows):
    """Nulls in any column, empty and very long texts, repeated rows, empty tables: every query gives its result."""
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{tmp_out}/documents.parquet")
    spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "item_id bigint, text string").write.parquet(
        f"{tmp_out}/benchmark.parquet")
    spark.createDataFrame([(r[0], r[3], r[1]) for r in rows], "page_id bigint, url string, html string").write.parquet(
        f"{tmp_out}/pages.parquet")
    for name, (source, _) in CONTRACT.items():
        got = QUERIES[name](spark, tmp_out).collect()
        if source:
            assert len(got) == len(rows), name
