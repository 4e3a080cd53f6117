"""Registered queries of the subpackage and their DuckDB oracles.

Each ``opN_<name>`` reads its whole table, applies the operator with its
production parameters and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (decontaminate, html_extract, importance_resample, language_id, lexical_search, license_scan, line_dedup, mixing,
                            quality_rules, sharding, simhash_dedup, substring_dedup, suffix_dedup)
from ledgerline.llm.common import table

# Words as the operators split them, in DuckDB's regular expressions.
WORD_SQL = "[^\\x20\\x09-\\x0D]+"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("item_id", "text"))


def _rule_sql(r: quality_rules.Rule) -> str:
    ratio = f"(CASE WHEN {r.denominator} > 0 THEN {r.numerator} / {r.denominator} ELSE 0.0 END)"
    parts = [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return " AND ".join(parts)


def _op7_sql() -> str:
    stop = sorted(set(quality_rules.STOP_WORDS) | {x.capitalize() for x in quality_rules.STOP_WORDS})
    stops = ", ".join(f"'{x}'" for x in stop)
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, rid, text, regexp_extract_all(text, '{WORD_SQL}') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS t
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop_words, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*\\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})[ \\t]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (rid)
), b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(f'({_rule_sql(r)})' for r in quality_rules.RULES)} AS kept
FROM b"""


OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS ws FROM documents
), w AS (
  SELECT rid, doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS p FROM d)
), f AS (
  SELECT h, min(doc_id) AS least FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT rid, unnest(range(p, p + 50)) AS i FROM w JOIN f USING (h) WHERE doc_id > least
), g AS (
  SELECT rid, list(i) AS gone FROM c GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
         list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)"""

# The remainder of a byte by the reflected polynomial of CRC-32, then bytes in order.
OP12_SQL = """
WITH RECURSIVE bits(i, k, r) AS (
  SELECT i, 0, i::BIGINT FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(r ORDER BY i) AS t FROM bits WHERE k = 8
), uses AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 1, NULL, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), w AS (
  SELECT side, rid, unnest(ws) AS word FROM uses
), bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))), lambda j: ('0x' || substr(hex(encode(word)), (2 * j + 1)::BIGINT, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM w)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table
), totals AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM totals
), weights AS (
  SELECT rid, sum(gain)::BIGINT AS weight FROM w JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY rid
), scored AS (
  SELECT u.rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
         + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM uses u LEFT JOIN weights USING (rid) WHERE side = 0
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (rid)"""

OP13_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, row_number() OVER () AS iid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
), q AS (
  SELECT item_id, iid, term, count(*) AS uses FROM i GROUP BY ALL
), total AS (
  SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0
), p AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * max(n) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, total GROUP BY term
), m AS (
  SELECT rid, doc_id, 75 + (25 * len(ws)::BIGINT * n) // l AS m FROM d, total
), scored AS (
  SELECT iid, item_id, doc_id, rid, sum(uses * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extract": op10_html_extract,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_importance_resample": op12_importance_resample,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op7_quality_rules": _op7_sql(),
    "op11_substring_dedup": OP11_SQL,
    "op12_importance_resample": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
