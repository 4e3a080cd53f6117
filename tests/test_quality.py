from ledgerline.operators import quality as Q


def _v(df):
    return {r["check"]: r["violations"] for r in df.collect()}


def test_unique_and_not_null(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    bad = spark.createDataFrame([(1, "a"), (1, None), (1, "c")], "id long, name string")
    assert _v(Q.check_unique(good, ["id"], "t")) == {"unique:t": 0}
    assert _v(Q.check_unique(bad, ["id"], "t")) == {"unique:t": 2}
    assert _v(Q.check_not_null(bad, ["id", "name"], "t")) == {"not_null:t.id": 0, "not_null:t.name": 1}


def test_positive_bounds_coverage(spark):
    df = spark.createDataFrame([(1, 2.0), (0, -1.0)], "q long, p double")
    assert _v(Q.check_positive(df, ["q", "p"], "t")) == {"positive:t.q": 1, "positive:t.p": 1}
    days = spark.createDataFrame([("2025-01-01",), ("2025-01-03",)], "d string").selectExpr("cast(d as date) d")
    assert _v(Q.check_date_bounds(days, "d", "2025-01-01", "2025-01-03")) == {"date_bounds": 0}
    assert _v(Q.check_date_bounds(days, "d", "2025-01-01", "2025-01-04")) == {"date_bounds": 1}
    assert _v(Q.check_date_coverage(days, "d", "2025-01-01", "2025-01-03")) == {"date_coverage": 1}


def test_foreign_keys_and_recipes(spark):
    parent = spark.createDataFrame([(1,), (2,)], "product_id long")
    child = spark.createDataFrame([(1,), (3,), (3,)], "product_id long")
    assert _v(Q.check_foreign_keys([("c", child, parent, "product_id")])) == {"foreign_key:c": 2}
    assert _v(Q.check_recipe_coverage(parent, child)) == {"recipe_coverage": 1}


def test_sets_counts_lookup_additive(spark):
    a = spark.createDataFrame([("x",), ("y",)], "n string")
    b = spark.createDataFrame([("y",), ("z",)], "n string")
    assert _v(Q.check_catalog_equal(a, a)) == {"catalog_equal": 0}
    assert _v(Q.check_catalog_equal(a, b)) == {"catalog_equal": 2}
    assert _v(Q.check_counts_kept({"t": a}, {"t": a})) == {"counts_kept": 0}
    assert _v(Q.check_counts_kept({"t": a}, {"t": a.limit(1)})) == {"counts_kept": 1}
    p = spark.createDataFrame([("Chicken Biryani",), ("Beef Biryani",)], "name string")
    assert _v(Q.check_nocase_lookup(p, "chicken biryani")) == {"nocase_lookup": 0}
    assert _v(Q.check_nocase_lookup(p, "biryani")) == {"nocase_lookup": 1}
    parts = spark.createDataFrame([(1, 2), (3, 4)], "r long, c long")
    assert _v(Q.check_additive(parts, spark.createDataFrame([(4, 6)], "r long, c long"), ["r", "c"])) == {"additive": 0}
    assert _v(Q.check_additive(parts, spark.createDataFrame([(4, 7)], "r long, c long"), ["r", "c"])) == {"additive": 1}


def test_fixture_facts(tables):
    gaps = [r["day"].isoformat() for r in Q.date_gaps(tables.orders, "order_date", "1995-01-01", "2001-08-01")
            .orderBy("day").collect()]
    assert len(gaps) == 6 and gaps[:2] == ["1997-10-25", "1998-05-23"]
    assert _v(Q.check_unique(tables.order_items, ["order_id", "line_number"], "x")) == {"unique:x": 60000 - 45832}
