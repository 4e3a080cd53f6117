"""Corpus pipeline: language ID, SimHash near-dedup, decontamination, mixing, sharding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the rows that go on. ``run`` applies them to ``documents``: each
stage's result is written as Parquet into the shared checkpoint folder and
read again, so a lost executor costs one stage at most. All stages but the
last return the columns of their input; the last adds ``shard`` and ``slot``.

1. language_id      documents without a language (no letter, or no language
                    with a fair share of the words) go
2. near_dedup       one document of each group of near-duplicates stays
3. decontaminate    documents with a passage of a benchmark item go
4. mix              documents are taken 0 to 3 times towards the source weights
5. shard            seeded shuffle into 16 shards of equal counts

No stage caps, samples or reads prefixes; an empty table passes through all
of them as an empty table. The language model, near-duplicate links and the
random mix have no SQL form, so ORACLE_SQL is None and the stages are tested
against brute-force versions (tests/llm/test_pipeline.py).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontaminate, language_id, mixing, sharding, simhash_dedup
from ledgerline.llm.common import fresh, table
from ledgerline.session import checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    label, score = fresh(docs, "_lang", 2)
    return language_id.accepted(docs, language_id.train(docs), label, score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
