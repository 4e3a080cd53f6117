import datetime as dt

import pytest

from ledgerline.operators.guard import GuardError, check_text, guarded_select


def _tables(spark):
    def build(s):
        return {"products": s.createDataFrame([(1, "Tea", 12000), (2, "Coffee", 30000)],
                                               "product_id long, name string, price_cents long"),
                "orders": s.createDataFrame([(1, dt.date(2026, 6, 1)), (2, dt.date(2026, 7, 1))],
                                            "order_id long, order_date date")}
    return build


def test_trailing_semicolon_and_money(spark):
    df, labels = guarded_select(spark, "  SELECT name, price_cents FROM products ORDER BY product_id ; ",
                                _tables(spark))
    assert labels == ["price_pkr"]
    assert [tuple(r) for r in df.collect()] == [("Tea", 120.0), ("Coffee", 300.0)]


def test_parameters_bound_by_name(spark):
    df, _ = guarded_select(spark, "SELECT count(*) AS n FROM orders WHERE order_date BETWEEN :date_start AND :date_end",
                           _tables(spark), period={"start": dt.date(2026, 6, 1), "end": dt.date(2026, 6, 30)})
    assert df.first()["n"] == 1


@pytest.mark.parametrize("sql", [
    "SELECT 1; SELECT 2", "SELECT ';' AS x", "WITH a AS (SELECT 1) SELECT * FROM a",
    "-- hi\nSELECT 1", "VALUES (1)", "DROP TABLE products", "", 42, None,
])
def test_text_refusals(sql):
    with pytest.raises(GuardError):
        check_text(sql)


@pytest.mark.parametrize("sql", [
    "SELECT * FROM secrets",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
    "SELECT * FROM products WHERE product_id IN (SELECT id FROM other_table)",
])
def test_unlisted_tables_refused(spark, sql):
    with pytest.raises(Exception):
        guarded_select(spark, sql, _tables(spark))[0].collect()


def test_missing_period_parameter(spark):
    with pytest.raises(GuardError):
        guarded_select(spark, "SELECT * FROM orders WHERE order_date >= :date_start", _tables(spark),
                       period={"start": dt.date(2026, 6, 1), "end": dt.date(2026, 6, 30)})
    with pytest.raises(Exception):
        guarded_select(spark, "SELECT * FROM orders WHERE order_date >= :date_start", _tables(spark))[0].collect()


def test_sandbox_does_not_leak_views(spark):
    guarded_select(spark, "SELECT * FROM products", _tables(spark))
    assert "products" not in [t.name for t in spark.catalog.listTables()]


@pytest.mark.parametrize("sql", [
    "SELECT * FROM global_temp.orders",
    "SELECT * FROM otherdb.orders",
    "SELECT * FROM `otherdb`.`orders`",
    "SELECT * FROM spark_catalog.otherdb.orders",
    "SELECT (SELECT max(order_id) FROM otherdb.orders) AS m FROM products",
    "SELECT * FROM products WHERE EXISTS (SELECT 1 FROM global_temp.orders)",
    "SELECT * FROM (SELECT * FROM otherdb.orders) x",
    "SELECT * FROM products WHERE product_id IN (SELECT order_id FROM orders WHERE order_id = (SELECT max(id) FROM a.b))",
    "SELECT * FROM products UNION ALL SELECT * FROM secrets",
    "SELECT * FROM products JOIN LATERAL (SELECT * FROM x.y) z",
    "SELECT * FROM range(5)",
    "SELECT * FROM (WITH a AS (SELECT * FROM products) SELECT * FROM a) b",
    "SELECT name FROM products WHERE reflect('a', 'b') = 'c'",
    "SELECT s.java_method('a') FROM products",
    "SELECT reflect('java.lang.System', 'exit', '0')", "SELECT try_reflect('a', 'b')", "SELECT `reflect`('a', 'b')",
    "SELECT java_method('a', 'b')", "SELECT Reflect('a', 'b')",
])
def test_parse_tree_refusals(spark, sql):
    with pytest.raises(GuardError):
        guarded_select(spark, sql, _tables(spark))


def test_allowed_shapes(spark):
    df, _ = guarded_select(spark, "SELECT `reflect` FROM (SELECT name AS reflect FROM Products p JOIN orders o ON "
                                  "p.product_id = o.order_id WHERE EXISTS (SELECT 1 FROM orders)) x", _tables(spark))
    assert {r[0] for r in df.collect()} == {"Tea", "Coffee"}


@pytest.mark.parametrize("sql", [
    "SELECT * FROM identifier('global_temp.hidden_t')", "SELECT * FROM identifier('products')",
    "SELECT * FROM identifier('global_temp.' || 'hidden_t')", "SELECT * FROM `global_temp`.`hidden_t`",
    "SELECT * FROM products WHERE EXISTS (SELECT 1 FROM identifier('global_temp.hidden_t'))",
    "SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT (SELECT identifier('java_' || 'method')('java.lang.System', 'getProperty', 'user.home')) AS x FROM products",
    "SELECT identifier('name') FROM products", "SELECT * FROM products, LATERAL (SELECT * FROM identifier('products')) z",
    "SELECT * FROM (SELECT * FROM (SELECT * FROM identifier('global_temp.hidden_t')) a) b",
    "SELECT TRANSFORM(name) USING 'cat' FROM products", "SELECT * FROM products LATERAL VIEW explode(array(1)) t AS x",
    "SELECT * FROM products TABLESAMPLE (10 PERCENT)", "SELECT /*+ BROADCAST(p) */ * FROM products p", "SELECT current_user()",
    "SELECT input_file_name() FROM products", "SELECT java_method('java.lang.System', 'exit', '0')", "SELECT stack(2, 1, 2)",
    "SELECT count(*) FROM (VALUES (1)) t", "SELECT * FROM products |> WHERE true", "SELECT name, raise_error('x') FROM products",
])
def test_unlisted_constructs_refused(spark, sql):
    spark.createDataFrame([(1,)], "x int").createOrReplaceGlobalTempView("hidden_t")
    with pytest.raises(GuardError):
        guarded_select(spark, sql, _tables(spark))


@pytest.mark.parametrize("sql", [
    "SELECT category, sum(price_cents) AS total_cents FROM (SELECT 'a' AS category, price_cents FROM products) x GROUP BY category "
    "HAVING sum(price_cents) > 1 ORDER BY 2 DESC LIMIT 3",
    "SELECT CASE WHEN price_cents > 1 THEN 1 ELSE 0 END AS x, CAST(price_cents AS double) AS d, row_number() OVER (PARTITION BY name "
    "ORDER BY price_cents) AS rn, sum(price_cents) OVER (ORDER BY product_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, -price_cents AS n FROM products",
    "SELECT a.* FROM products a LEFT JOIN products b USING (product_id) WHERE a.name IN ('Tea') AND a.name IS NOT NULL AND NOT a.name = 'z'",
    "SELECT name FROM products UNION ALL SELECT name FROM products UNION SELECT 'x'", "SELECT DISTINCT name FROM products ORDER BY name OFFSET 1",
    "SELECT (SELECT max(price_cents) FROM products p WHERE p.product_id = o.order_id) AS m, trim(both ' ' from 'a') AS t FROM orders o",
    "SELECT year(order_date) AS y, extract(month from order_date) AS m, date_format(order_date, 'yyyy') AS f, count(DISTINCT order_id) AS n "
    "FROM orders WHERE order_date >= DATE '2026-01-01' - INTERVAL 1 DAY GROUP BY ALL",
    "SELECT name, avg(price_cents) AS a, min(name) AS b, round(stddev(price_cents), 2) AS s, count(*) FILTER (WHERE price_cents > 1) AS c, "
    "percentile_approx(price_cents, 0.5) AS p, grouping(name) AS g FROM products GROUP BY ROLLUP (name)",
    "SELECT upper(name) || lower(name) AS a, substring(name, 1, 2) AS b, replace(name, 'a', 'b') AS c, coalesce(name, 'x') AS d, "
    "round(price_cents / 7, 1) AS e, price_cents % 3 AS f, price_cents DIV 2 AS g, nullif(name, 'a') AS h, concat_ws(',', name, name) AS i, "
    "greatest(price_cents, 1) AS j, ceil(price_cents / 3) AS k, date_add(current_date(), 1) AS l, to_date('2020-01-01') AS m FROM products",
    "SELECT * FROM products WHERE name LIKE 'T%' AND price_cents BETWEEN 1 AND 99999 AND product_id IN (SELECT order_id FROM orders)",
    "SELECT name FROM products EXCEPT SELECT 'Tea'",
])
def test_listed_constructs_run(spark, sql):
    guarded_select(spark, sql, _tables(spark))[0].collect()


def test_analysed_plan_is_checked(spark):
    """The second look alone: a plan over another session's view, a file or a range does not pass."""
    from ledgerline.operators.guard import check_analysed
    _tables(spark)(spark)["products"].createOrReplaceTempView("guard_view")
    check_analysed(spark, spark.sql("SELECT name FROM guard_view"), {"guard_view"})
    for df in (spark.sql("SELECT name FROM guard_view"), spark.range(3), spark.sql("SELECT reflect('java.lang.Math', 'abs', -1)"),
               spark.sql("SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`")):
        with pytest.raises(GuardError):
            check_analysed(spark, df, {"other"})


def test_work_budget_refuses_before_running(spark):
    def big(s):
        return {"facts": s.range(200_000_000).selectExpr("id", "id % 7 AS v")}
    linear = "SELECT v, count(*) AS n FROM facts GROUP BY v"
    pairs = "SELECT count(*) AS n FROM facts a JOIN facts b ON a.id < b.id"
    hidden = "SELECT id FROM facts WHERE id = (SELECT count(*) FROM facts a JOIN facts b ON a.id < b.id)"
    guarded_select(spark, linear, big, budget=100 << 30)
    guarded_select(spark, "SELECT count(*) AS n FROM facts a JOIN facts b ON a.id = b.id", big, budget=100 << 30)
    for sql, budget in ((pairs, 100 << 30), (hidden, 100 << 30), (linear, 1 << 20)):
        with pytest.raises(GuardError, match="over budget"):
            guarded_select(spark, sql, big, budget=budget)


def test_deadline_cancels_jobs(spark):
    import time

    from ledgerline.operators.guard import deadline
    with deadline(spark, 60):
        assert spark.range(10).count() == 10
    t0 = time.time()
    with pytest.raises(GuardError, match="over budget"):
        with deadline(spark, 2):
            spark.range(0, 1 << 45, 1, 8).selectExpr("sum(hash(id))").collect()
    assert time.time() - t0 < 60
    assert spark.range(5).count() == 5          # the session goes on
    with pytest.raises(ZeroDivisionError):      # other errors stay what they are
        with deadline(spark, 60):
            1 / 0
