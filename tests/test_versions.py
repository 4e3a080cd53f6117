"""Buckets, copy-on-write and compare-and-set of versioned tables."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.operators import versions as V
from ledgerline.operators.rewrite import upsert_by_key

SCHEMA = "id long, v string"


def _rows(spark, base, number=None):
    of = V.latest(spark, base) if number is None else V.version(spark, base, number)
    return {r["id"]: r["v"] for r in V.read(spark, base, of, SCHEMA).collect()}


def _merge(old, batch):
    return upsert_by_key(old, batch, "id")


def test_upsert_rewrites_only_touched_buckets(spark, tmp_out):
    base = os.path.join(tmp_out, "table")
    assert V.latest(spark, base) == V.Version(0, {}) and _rows(spark, base) == {}
    first = V.upsert(spark.range(500).selectExpr("id", "'a' AS v"), base, SCHEMA, F.col("id"), _merge, buckets=16)
    assert first.number == 1 and len(first.folders) == 16
    second = V.upsert(spark.createDataFrame([(7, "b"), (7, "b")], SCHEMA), base, SCHEMA, F.col("id"), _merge, buckets=16)
    changed = [b for b in second.folders if second.folders[b] != first.folders[b]]
    assert second.number == 2 and len(changed) == 1
    assert _rows(spark, base) == {i: "b" if i == 7 else "a" for i in range(500)}
    assert set(_rows(spark, base, 1).values()) == {"a"}
    assert V.upsert(spark.createDataFrame([], SCHEMA), base, SCHEMA, F.col("id"), _merge) == second


def test_of_two_racing_writers_one_fails(spark, tmp_out):
    base = os.path.join(tmp_out, "table")
    start = V.upsert(spark.createDataFrame([(1, "a")], SCHEMA), base, SCHEMA, F.col("id"), _merge, buckets=1)

    def write(value):
        return V.publish(spark.createDataFrame([(1, value)], SCHEMA).withColumn(V.BUCKET, F.lit(0)), base, start, [0])
    assert write("b").number == 2
    with pytest.raises(V.Conflict):
        write("c")
    assert _rows(spark, base) == {1: "b"}
    assert not [n for n in os.listdir(os.path.join(base, "_versions")) if "draft" in n]
    # an upsert that meets a conflict merges again on the new version
    tries = []

    def merge(old, batch):
        if not tries:
            V.upsert(spark.createDataFrame([(2, "other")], SCHEMA), base, SCHEMA, F.col("id"), _merge, buckets=1)
        tries.append(1)
        return _merge(old, batch)
    V.upsert(spark.createDataFrame([(3, "mine")], SCHEMA), base, SCHEMA, F.col("id"), merge, buckets=1)
    assert len(tries) == 2 and _rows(spark, base) == {1: "b", 2: "other", 3: "mine"}


def test_failed_check_publishes_nothing(spark, tmp_out):
    base = os.path.join(tmp_out, "table")
    start = V.upsert(spark.createDataFrame([(1, "a")], SCHEMA), base, SCHEMA, F.col("id"), _merge, buckets=2)
    bad = spark.createDataFrame([(5, None)], SCHEMA)
    with pytest.raises(RuntimeError, match="not_null"):
        V.upsert(bad, base, SCHEMA, F.col("id"), _merge, lambda t: Q.check_not_null(t, ["v"], "t"), buckets=2)
    assert V.latest(spark, base) == start
    with pytest.raises(ValueError):
        V.publish(bad.withColumn(V.BUCKET, F.lit(1)), base, start, [0])
