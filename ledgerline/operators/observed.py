"""Checks taken in the pass that writes a table.

``write_observed`` writes each table once. The checks of a table ride on that
write as one ``Observation``: counts, bounds, NULL and sign checks are
aggregates over the rows as they pass; a reference adds a left join with the
other table's distinct keys (its marker is counted, then dropped before the
sink); for uniqueness, which no aggregate without DISTINCT tells, the rows are
numbered inside their key on the way. Nothing that was written is read again
but the footers.

A metric counts each row once as long as no task of the write is run twice
with a result each time; Spark takes accumulators of a failed attempt away,
but a stage that is run again after an executor was lost adds its rows again.
``write_observed`` therefore observes the last stage only (the one that feeds
the sink) and compares the observed number of rows with the Parquet footers of
the files that were committed; if they differ, the table is checked by reading
it (``reread``), never published on a doubtful count.

Defined results: an empty table has no violation but of ``rows``, ``bounds``
and ``covered``. A null key of a reference is an orphan; null keys count as equal
for uniqueness, as in ``quality``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import as_date

ROWS = "rows"


@dataclass(frozen=True)
class Rule:
    """One check. ``measure`` is an aggregate over the written rows, ``violations`` reads its value.

    ``enrich`` may add the columns named in ``helpers`` before the write; they are measured and dropped.
    """
    check: str
    measure: Column
    violations: Callable[[object], int] = lambda x: int(x or 0)
    enrich: Callable[[DataFrame], DataFrame] | None = None
    helpers: list[str] = field(default_factory=list)


def rows(name: str, expected: int) -> Rule:
    return Rule(f"row_count:{name}", F.count(F.lit(1)), lambda n: abs(n - expected))


def bounds(col: str, start, end) -> Rule:
    lo, hi = F.min(col), F.max(col)
    bad = (F.when(lo.isNull() | (lo != as_date(start)), 1).otherwise(0)
           + F.when(hi.isNull() | (hi != as_date(end)), 1).otherwise(0))
    return Rule("date_bounds", bad)


def covered(col: str, start, end) -> Rule:
    """Days of the range without a row. The set that is gathered holds days of the range only, so it is bounded by the calendar."""
    day = F.col(col).cast("date")
    seen = F.size(F.collect_set(F.when(day.between(as_date(start), as_date(end)), day)))
    return Rule("date_coverage", F.datediff(as_date(end), as_date(start)) + 1 - seen)


def not_null(name: str, cols: list[str]) -> list[Rule]:
    return [Rule(f"not_null:{name}.{c}", F.count_if(F.col(c).isNull())) for c in cols]


def positive(name: str, cols: list[str]) -> list[Rule]:
    return [Rule(f"positive:{name}.{c}", F.count_if(F.col(c) <= 0)) for c in cols]


def references(check: str, parent: DataFrame, key: str, parent_key: str | None = None) -> Rule:
    """Rows whose ``key`` is not in ``parent``: a left join with its distinct keys, which adds no row."""
    mark = f"_held:{check}"
    keys = parent.select(F.col(parent_key or key).alias(f"_key:{check}")).distinct().withColumn(mark, F.lit(True))
    return Rule(check, F.count_if(F.col(f"`{mark}`").isNull()),
                enrich=lambda df: df.join(keys, F.col(key) == F.col(f"`_key:{check}`"), "left"),
                helpers=[mark, f"_key:{check}"])


def unique(name: str, keys: list[str | Column]) -> Rule:
    """Rows after the first of their key. The numbering spills, so a key of any number of rows passes."""
    at = f"_nth:{name}"
    order = Window.partitionBy(*keys).orderBy(F.lit(0))
    return Rule(f"unique:{name}", F.count_if(F.col(f"`{at}`") > 1),
                enrich=lambda df: df.withColumn(at, F.row_number().over(order)), helpers=[at])


def below(check: str, values: DataFrame, key: str, value: str, limit: str) -> Rule:
    """Rows whose ``value``, looked up by ``key`` in ``values`` (one row for each key), is not below the column ``limit``."""
    found, at = f"_value:{check}", f"_key:{check}"
    v = values.select(F.col(key).alias(at), F.col(value).alias(found))
    return Rule(check, F.count_if(F.col(f"`{found}`") >= F.col(limit)),
                enrich=lambda df: df.join(v, F.col(key) == F.col(f"`{at}`"), "left"), helpers=[found, at])


def observed(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Observation]:
    """``df`` with the rules' measures attached to the pass that reads it."""
    wide = df
    for r in rules:
        wide = r.enrich(wide) if r.enrich else wide
    watch = Observation()
    measures = [F.count(F.lit(1)).alias(ROWS)] + [r.measure.alias(f"m{i}") for i, r in enumerate(rules)]
    return wide.observe(watch, *measures).select(*[F.col(f"`{c}`") for c in df.columns]), watch


def _written(spark: SparkSession, path: str) -> int:
    """Rows of the committed files: a count that Spark answers from the Parquet footers."""
    return spark.read.parquet(path).count()


def reread(df: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """The rules' violations by one aggregate over ``df``."""
    wide = df
    for r in rules:
        wide = r.enrich(wide) if r.enrich else wide
    got = wide.agg(F.count(F.lit(1)).alias(ROWS), *[r.measure.alias(f"m{i}") for i, r in enumerate(rules)]).first()
    return {r.check: r.violations(got[f"m{i}"]) for i, r in enumerate(rules)}


def write_observed(tables: dict[str, DataFrame], target: str, rules: dict[str, list[Rule]],
                   partition_by: dict[str, list[str]] | None = None) -> list[tuple[str, int]]:
    """Write every table to ``target/<name>`` once; (check, violations) of all rules, from that pass."""
    out = []
    for name, df in tables.items():
        own = rules.get(name, [])
        wide, watch = observed(df, own)
        w = wide.write.mode("errorifexists")
        if partition_by and name in partition_by:
            w = w.partitionBy(*partition_by[name])
        w.parquet(f"{target}/{name}")
        got = watch.get
        spark = df.sparkSession
        if got[ROWS] == _written(spark, f"{target}/{name}"):
            out += [(r.check, r.violations(got[f"m{i}"])) for i, r in enumerate(own)]
        else:
            out += list(reread(spark.read.parquet(f"{target}/{name}"), own).items())
    return out
