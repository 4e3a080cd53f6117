"""Every registered query against its DuckDB oracle on sf0.001 (the driver
checks sf0.01); queries without an oracle must run and keep their schema."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "orders", "units", "revenue_pkr", "estimated_food_cost_pkr",
                          "estimated_gross_profit_pkr"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(registry.all_queries()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query_against_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    si = [df.columns.index(c) for c in cols]
    oi = [rel.columns.index(c) for c in cols]
    a = sorted((tuple(_norm(r[i]) for i in si) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in oi) for r in rel.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("absent", [("ledgerline/llm", "tests/llm"), ("ledgerline/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_out, absent):
    """In a copy without the optional folders or the pipeline, the entry imports and keeps all other queries."""
    here = os.path.dirname(os.path.abspath(E.__file__))
    parts = [os.path.join(here, a) for a in absent]
    copy = os.path.join(tmp_out, "copy")

    def left_out(folder, names):
        return [n for n in names if os.path.join(folder, n) in parts or n in (".git", "__pycache__")]
    shutil.copytree(here, copy, ignore=left_out)
    code = ("import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); "
            "from ledgerline.plans import registry; "
            "assert set(registry.all_queries()) <= set(q) and set(o) <= set(q); "
            "print(len(q) - len(registry.all_queries()), E.__file__)")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    extra, path = done.stdout.split()
    assert path.startswith(copy) and (int(extra) == 0) == ("ledgerline/llm" in absent)


def test_a_missing_package_is_not_hidden(monkeypatch):
    """Only the optional parts themselves may be absent, not something that they need."""
    def broken(name):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
    monkeypatch.setattr(E.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        E._optional("ledgerline.llm.queries")
