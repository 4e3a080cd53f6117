import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import generate as G
from ledgerline.operators.partitioning import number_within, running_sum


def test_number_within_matches_row_number(spark):
    """More rows than a range sample holds, a hot group, a null group, columns that are no keys."""
    df = (spark.range(240_000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None)
                                          .otherwise(F.concat(F.lit("g"), F.col("id") % 11)))
          .withColumn("o", F.xxhash64("id")).withColumn("text", F.concat(F.lit("text "), F.col("id")))
          .repartition(7))
    got = number_within(df, ["g"], ["o"], "pos", 3000)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert got.columns == ["id", "g", "o", "text", "pos"]
    both = got.join(want.select("id", F.col("text").alias("wanted_text"), "rn"), "id")
    assert got.count() == 240_000
    assert both.where("pos = rn AND text = wanted_text").count() == 240_000


def test_number_within_kinds_of_order(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(days=i % 50), f"é{i % 13}", i / 7 if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, d date, s string, x double")
    for first in ("d", "s", "x"):
        got = {r["id"]: r["pos"] for r in number_within(df, [], [first, "id"], "pos", 30).collect()}
        want = {r["id"]: r["rn"] for r in
                df.withColumn("rn", F.row_number().over(Window.orderBy(first, "id"))).collect()}
        assert got == want
    assert number_within(df.limit(0), [], ["id"]).count() == 0


@pytest.mark.parametrize("order", [
    # 95 % of the rows in 1 % of the range
    "CASE WHEN id % 20 <> 0 THEN pmod(xxhash64(id), 10000000) ELSE pmod(xxhash64(id), 1000000000) END / 1e9D",
    # one long prefix for all, then one of two long prefixes
    "repeat('s3/bucket/', 30) || CASE WHEN id % 3 = 0 THEN repeat('left/', 20) ELSE repeat('right/', 20) END || hex(xxhash64(id))",
    # nulls, and values shared by many rows
    "CASE WHEN id % 4 <> 0 THEN id % 3 END",
])
def test_bins_are_even(spark, order):
    """Right positions and no bin above twice the mean, however the order column is spread."""
    from ledgerline.operators import partitioning as P
    df = spark.range(120_000).withColumn("o", F.expr(order)).repartition(6)
    binned = P._with_bin(df, ["o", "id"], "b", 3000)
    sizes = [r["count"] for r in binned.groupBy("b").count().collect()]
    assert 36 <= len(sizes) <= 40 and max(sizes) <= 2 * 3000
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("o", "id"))).select("id", "rn")
    assert number_within(df, [], ["o", "id"], "pos", 3000).join(want, "id").where("pos = rn").count() == 120_000


def test_columns_keep_their_values(spark):
    """Columns named like the helper columns come out as they went in."""
    names = ["_bin", "_n", "_before", "_g0", "_b", "_w0", "_w1", "_w2", "_w3", "_s0", "_o0", "_t0"]
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), *[F.lit(f"mine {c}").alias(c) for c in names])
    for out in (number_within(df, ["g"], ["id"], "pos", 100), running_sum(df, ["id"], "g", "sum", 100)):
        assert out.count() == 500
        assert out.where(" AND ".join(f"{c} = 'mine {c}'" for c in names)).count() == 500


def test_running_sum_matches_cumsum(spark):
    df = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 5).alias("w"),
                                     F.when(F.col("id") % 2 == 0, 1).alias("v"), F.lit("x").alias("other")).repartition(5)
    got = running_sum(df, ["k"], ["w", "v"], ["c", "e"], 1500).orderBy("k").collect()
    a = b = 0
    for r in got:
        a, b = a + r["w"], b + (r["v"] or 0)
        assert (r["c"], r["e"]) == (a, b)
    assert len(got) == 100_000


def test_weighted_choice_proportions(spark):
    df = spark.range(20000)
    c = Counter(r[0] for r in df.select(G.weighted_choice(G.uniform32(7, F.col("id")), G.BRANCHES)).collect())
    assert abs(c["Suwaiq"] / 20000 - 0.6) < 0.02


def test_fixed_mix_exact(spark):
    df = spark.range(3500).withColumnRenamed("id", "order_id")
    c = Counter(r["size"] for r in G.fixed_mix_shuffle(df, "order_id", 1).collect())
    assert c == {1: 1400, 2: 700, 3: 1400}


def test_weighted_sample_distinct(spark):
    orders = spark.createDataFrame([(i, 1 + i % 3) for i in range(300)], "order_id long, size int")
    products = spark.createDataFrame([(1, 5), (2, 0), (3, 1), (4, 2)], "product_id long, weight long")
    a = G.weighted_sample_distinct(orders, products, 11).collect()
    b = G.weighted_sample_distinct(orders, products, 11).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    per = Counter(r["order_id"] for r in a)
    assert all(per[i] == 1 + i % 3 for i in range(300))
    assert all(r["product_id"] != 2 for r in a)  # weight 0 is never drawn
    assert len({(r["order_id"], r["product_id"]) for r in a}) == len(a)
    # size = number of drawable products: every one of them is chosen
    full = spark.createDataFrame([(1, 3)], "order_id long, size int")
    assert {r["product_id"] for r in G.weighted_sample_distinct(full, products, 3).collect()} == {1, 3, 4}
    with pytest.raises(ValueError):
        G.weighted_sample_distinct(spark.createDataFrame([(1, 4)], "order_id long, size int"), products, 3)
    heavy = spark.createDataFrame([(1, 10**9), (2, 1), (3, 10**9)], "product_id long, weight long")
    two = spark.createDataFrame([(i, 2) for i in range(50)], "order_id long, size int")
    assert {r["product_id"] for r in G.weighted_sample_distinct(two, heavy, 3).collect()} == {1, 3}
    assert G.weighted_sample_distinct(two.limit(0), heavy, 3).count() == 0


def test_weighted_sample_ways_agree(spark):
    """Broadcast weights and joins in rounds give the same draws; a repeated, null or zero order as well."""
    orders = spark.createDataFrame([(i, i % 5) for i in range(400)] + [(7, 2), (None, 1), (500, None)], "order_id long, size int").repartition(3)
    products = spark.createDataFrame([(10 + i, w) for i, w in enumerate([1000, 1, 1, 0, 7, 30, 2])] + [(99, None)], "product_id int, weight long")
    few = orders.where("order_id <> 7")
    a = sorted(map(tuple, G.weighted_sample_distinct(few, products, 5).collect()))
    b = sorted(map(tuple, G.weighted_sample_distinct(few, products, 5, broadcast_rows=3).collect()))
    assert a == b and len(a) == sum(i % 5 for i in range(400)) - 2
    assert G.weighted_sample_distinct(orders, products, 5).count() == sum(i % 5 for i in range(400)) + 2 + 1


def test_weighted_sample_rounds_with_repeated_and_skewed_rows(spark):
    """Rows that share a key draw as one sequence in both ways; nearly all weight on one product takes many rounds."""
    orders = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 1), (3, None), (4, 0)] + [(i, i % 4) for i in range(5, 60)], "order_id long, size int")
    products = spark.createDataFrame([(p, 400 if p == 3 else 1) for p in range(8)], "product_id long, weight long")
    a = sorted(map(tuple, G.weighted_sample_distinct(orders, products, 5).collect()))
    b = sorted(map(tuple, G.weighted_sample_distinct(orders, products, 5, broadcast_rows=3).collect()))
    assert a == b and len(a) == 9 + sum(i % 4 for i in range(5, 60))
