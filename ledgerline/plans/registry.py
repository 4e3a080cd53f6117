"""Named queries and their SQL oracles.

``register(name, oracle)`` records a builder ``fn(t: Tables) -> DataFrame``
under ``name``; ``oracle`` is the DuckDB SQL that computes the same rows on
the raw tables (``None`` when the operator is not expressible in SQL). Role
CTEs are prepended to an oracle with ``roles=True``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources import roles


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[roles.Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: str | None = None, use_roles: bool = True):
    def deco(fn: Callable[[roles.Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        sql = roles.with_roles(oracle) if (oracle and use_roles) else oracle
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q.build(roles.load(spark, sf_dir))

    run.__name__ = name
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: runner(n) for n in QUERIES}


def all_oracles() -> dict[str, str]:
    _load_all()
    return {n: q.oracle for n, q in QUERIES.items() if q.oracle}


def _load_all() -> None:
    # Importing the modules registers their queries.
    from ledgerline.plans import (  # noqa: F401
        q_sales, q_recipes, q_scans, q_periods, q_quality, q_retrieval,
        q_answers, q_generate, q_rewrite,
    )
