"""Retrieval queries: pages, chunks, vector and text top-k, context, sources, index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import retrieval as R
from ledgerline.operators import text_index, vector_index
from ledgerline.plans.registry import register
from ledgerline.session import checkpoint_dir

WS_SQL = r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'"
TOKEN_SQL = r"'[^\p{L}\p{N}]+'"
# Re-index binding: documents in English are chunked again with 300/50.
REINDEX_LANG = "en"
REINDEX_SIZE, REINDEX_OVERLAP = 300, 50


def _pages(t):
    return R.page_text(t.raw("documents"), keep=["lang"])


def _chunks(t):
    return R.chunk_records(_pages(t).drop("lang"))


def _hits_and_chunks(t):
    """The best chunks of the benchmark's items (a few per item, to be broadcast), and the chunks: made once, read for both."""
    checkpoint_dir(t.spark)
    chunks = _chunks(t).checkpoint()
    bench = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return F.broadcast(R.text_top_k(bench, chunks, k=3)), chunks


def _new_folder(df: DataFrame) -> str:
    """A folder for an index, in the shared checkpoint folder."""
    return f"{checkpoint_dir(df.sparkSession)}/index-{uuid.uuid4().hex}"


def _norm(col: str) -> str:
    return f"trim(regexp_replace({col}, {WS_SQL}, ' ', 'g'))"


PAGES_SQL = f"""
pg AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page,
              text, lang FROM documents),
pages AS (SELECT * FROM pg WHERE {_norm('text')} <> ''),
"""


def _chunk_sql(src: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""(SELECT regexp_replace(source, '\\.[^.]*$', '') || '_p' || page || '_c' || (i + 1) AS id,
        source, page, CAST(i + 1 AS INTEGER) AS chunk, substring(t, i * {step} + 1, {size}) AS text
 FROM (SELECT source, page, t, unnest(range(0, greatest(0, length(t) - {overlap + 1}) // {step} + 1)) AS i
       FROM (SELECT source, page, {_norm('text')} AS t FROM {src}) n WHERE length(t) > 0) c)"""


CHUNKS_SQL = PAGES_SQL + f"chunks AS {_chunk_sql('pages', 450, 70)}\n"


def _with(body: str, extra: str = "") -> str:
    return "WITH " + CHUNKS_SQL + extra + body


@register("page_text", "WITH " + PAGES_SQL.rstrip().rstrip(",") + "\nSELECT source, page, text FROM pages",
          use_roles=False)
def q_page_text(t):
    return _pages(t).drop("lang")


@register("chunk_text", f"""
SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk, substring(t, i * 380 + 1, 450) AS chunk_text
FROM (SELECT doc_id, t, unnest(range(0, greatest(0, length(t) - 71) // 380 + 1)) AS i
      FROM (SELECT doc_id, {_norm('text')} AS t FROM documents) n WHERE length(t) > 0) c""", use_roles=False)
def q_chunk_text(t):
    return R.chunk_text(t.raw("documents").select("doc_id", "text")).select("doc_id", "chunk", "chunk_text")


@register("chunk_records", _with("SELECT * FROM chunks"), use_roles=False)
def q_chunk_records(t):
    return _chunks(t)


VECTOR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q.query_id, e.vec_id,
             list_sum(list_transform(list_zip(q.qv, e.embedding),
                   lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS dist
      FROM q JOIN embeddings e ON len(q.qv) = len(e.embedding)),
r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id FROM r WHERE rank <= 3"""


def _vector_queries(t):
    return t.raw("embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@register("vector_top_k", VECTOR_SQL, use_roles=False)
def q_vector_top_k(t):
    return R.vector_top_k(_vector_queries(t), t.raw("embeddings"), k=3)


@register("vector_index_top_k", VECTOR_SQL, use_roles=False)
def q_vector_index_top_k(t):
    vectors = t.raw("embeddings")
    return vector_index.search(_vector_queries(t), vector_index.build(vectors, _new_folder(vectors)), k=3)


def _tok(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), {TOKEN_SQL}), lambda x: x <> '')"


BM25_SQL = f"""
docs AS (SELECT id, {_tok('text')} AS tok FROM chunks),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS avgdl FROM docs),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct({_tok('text')})) AS term FROM benchmark),
post AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT id, len(tok) AS dl, unnest(tok) AS term FROM docs) x
         WHERE term IN (SELECT term FROM q) GROUP BY id, term),
w AS (SELECT term, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
      FROM post GROUP BY term),
sc AS (SELECT q.query_id, p.id,
              list_sum(list(w.idf * (p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.dl / (SELECT avgdl FROM stats)))) ORDER BY term)) AS score
       FROM post p JOIN w USING (term) JOIN q USING (term) GROUP BY q.query_id, p.id),
hits AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
                        FROM sc) r WHERE rank <= 3)
"""


def _hits(t):
    bench = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.text_top_k(bench, _chunks(t), k=3)


@register("text_top_k", _with("SELECT query_id, rank, id FROM hits", ",\n" + BM25_SQL.strip() + "\n"),
          use_roles=False)
def q_text_top_k(t):
    return _hits(t)


@register("text_index_top_k", _with("SELECT query_id, rank, id FROM hits", ",\n" + BM25_SQL.strip() + "\n"),
          use_roles=False)
def q_text_index_top_k(t):
    chunks = _chunks(t)
    bench = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_index.search(bench, text_index.build(chunks, _new_folder(chunks)), k=3)


@register("build_context", _with("""
SELECT h.query_id, string_agg('Source: ' || c.source || ', page ' || c.page || chr(10) || 'Text: ' || c.text,
                              chr(10) || chr(10) ORDER BY h.rank) AS context
FROM hits h JOIN chunks c USING (id) GROUP BY h.query_id""", ",\n" + BM25_SQL.strip() + "\n"), use_roles=False)
def q_build_context(t):
    return R.build_context(*_hits_and_chunks(t))


@register("source_list", _with("""
SELECT query_id, string_agg(label, '; ' ORDER BY first_rank) AS sources
FROM (SELECT h.query_id, c.source || ' (page ' || c.page || ')' AS label, min(h.rank) AS first_rank
      FROM hits h JOIN chunks c USING (id) GROUP BY 1, 2) s
GROUP BY query_id""", ",\n" + BM25_SQL.strip() + "\n"), use_roles=False)
def q_source_list(t):
    return R.source_list(*_hits_and_chunks(t))


REINDEX_SQL = f""",
batch AS {_chunk_sql(f"(SELECT * FROM pages WHERE lang = '{REINDEX_LANG}')", REINDEX_SIZE, REINDEX_OVERLAP)},
idx AS (SELECT * FROM chunks WHERE id NOT IN (SELECT id FROM batch) UNION ALL SELECT * FROM batch)
"""


def _reindexed(t):
    pages = _pages(t)
    old = R.chunk_records(pages.drop("lang"))
    batch = R.chunk_records(pages.where(F.col("lang") == REINDEX_LANG).drop("lang"),
                            REINDEX_SIZE, REINDEX_OVERLAP)
    return R.index_upsert(old, batch)


@register("index_upsert", _with("SELECT * FROM idx", REINDEX_SQL), use_roles=False)
def q_index_upsert(t):
    return _reindexed(t)


@register("index_count", _with("SELECT count(*) AS chunks FROM idx", REINDEX_SQL), use_roles=False)
def q_index_count(t):
    return _reindexed(t).agg(F.count(F.lit(1)).alias("chunks"))
