import os

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.operators import rewrite as W
from ledgerline.sources import readers


def test_upsert_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    batch = spark.createDataFrame([(2, "B", 1), (4, "D", 1), (2, "BB", 2), (3, "c", 1)], "id long, v string, pos int")
    got = {r["id"]: r["v"] for r in W.upsert_by_key(old, batch, "id", order_col="pos").collect()}
    assert got == {1: "a", 2: "BB", 3: "c", 4: "D"}


def test_update_from_map_nocase(spark):
    p = spark.createDataFrame([(1, "Chicken Biryani", 250), (2, "Tea", 30)], "product_id long, name string, price_cents long")
    m = spark.createDataFrame([("CHICKEN BIRYANI", 45000)], "name string, value long")
    got = {r["product_id"]: r["price_cents"] for r in W.update_from_map(p, m, "name", "price_cents").collect()}
    assert got == {1: 45000, 2: 30}


def test_update_correlated_missing_product_fails_check(spark):
    items = spark.createDataFrame([(1, 1, 100), (2, 9, 100)], "order_id long, product_id long, unit_price_cents long")
    prods = spark.createDataFrame([(1, 450)], "product_id long, price_cents long")
    new = W.update_correlated(items, prods)
    v = {r["check"]: r["violations"] for r in Q.check_not_null(new, ["unit_price_cents"], "items").collect()}
    assert v == {"not_null:items.unit_price_cents": 1}


def test_add_column_default(spark):
    df = spark.createDataFrame([(1,)], "id long")
    once = W.add_column_default(df, "cost_cents")
    assert once.columns == ["id", "cost_cents"] and once.first()["cost_cents"] == 0
    assert W.add_column_default(once, "cost_cents") is once


def test_publish_validated(spark, tmp_out):
    base = os.path.join(tmp_out, "tables")
    good = spark.createDataFrame([(1,), (2,)], "id long")
    bad = spark.createDataFrame([(1,), (1,)], "id long")

    def checks(t):
        return Q.check_unique(t["t"], ["id"], "t.id")

    v1 = W.publish_validated({"t": good}, base, checks)
    assert W.latest_version_path(spark, base) == v1
    with pytest.raises(RuntimeError):
        W.publish_validated({"t": bad}, base, checks)
    assert W.latest_version_path(spark, base) == v1
    assert spark.read.parquet(f"{v1}/t").count() == 2


def test_csv_and_report_round_trip(spark, tmp_out):
    df = spark.createDataFrame([(2, "b", 1.5), (1, "a", 2.0)], "id long, name string, price double")
    path = W.export_csv(df, os.path.join(tmp_out, "csv"), ["id"])
    back = readers.read_csv_export(spark, path, "id long, name string, price double")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 2.0), (2, "b", 1.5)]
    bom = os.path.join(tmp_out, "bom.csv")
    with open(bom, "w", encoding="utf-8-sig") as f:
        f.write("id,name\n1,x\n")
    assert readers.read_csv_export(spark, bom, "id long, name string").first()["name"] == "x"
    rep = spark.createDataFrame([("PKR", 3)], "currency string, n long")
    rpath = W.write_report(rep, os.path.join(tmp_out, "report"))
    assert readers.read_report(spark, rpath).first()["currency"] == "PKR"


def test_gates(spark):
    meta = spark.createDataFrame([("currency", "PKR")], "key string, value string")
    readers.metadata_gate(meta, "currency", "PKR")
    with pytest.raises(RuntimeError):
        readers.metadata_gate(meta, "currency", "OMR")
    assert readers.has_column(meta, "key") and not readers.has_column(meta, "nope")


def test_map_rows(spark):
    """Null and empty maps give no row; a null value is kept; the update takes the largest price of a folded name."""
    lists = spark.createDataFrame([({"TEA": 45, "x": None},), ({"tea": 60},), ({},), (None,)], "prices map<string, bigint>")
    assert sorted(map(tuple, W.map_rows(lists, "prices").collect()), key=repr) == [("TEA", 45), ("tea", 60), ("x", None)]
    p = spark.createDataFrame([(1, "Tea", 1), (2, "X", 2)], "product_id long, name string, price_cents long")
    got = {r["product_id"]: r["price_cents"] for r in W.update_from_maps(p, lists, "prices", "name", "price_cents").collect()}
    assert got == {1: 60, 2: 2}
