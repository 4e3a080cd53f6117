"""Money as exact integer hundredths ("cents").

Every amount is held as ``bigint`` hundredths of the currency unit. Sums stay
exact and independent of summation order; conversion to currency units
happens once, at the very end, in :func:`money_columns`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CENTS_SUFFIX = "_cents"
UNITS_SUFFIX = "_pkr"


def to_cents(c: Column) -> Column:
    """A decimal amount (double) to whole hundredths.

    Doubles such as ``x*100`` are often not whole; round before the cast.
    """
    return F.round(c * 100).cast("bigint")


def half_even(c: Column, scale: int = 0) -> Column:
    """Banker's rounding. Exact at scale 0 (halves are representable)."""
    return F.bround(c, scale)


def cents_to_units(c: Column) -> Column:
    """Hundredths to currency units: fractional hundredths are rounded half-even to whole ones first
    (12.5 -> 0.12, 267.5 -> 2.68); NULL stays NULL."""
    return half_even(c.cast("double")) / 100.0


def money_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rename every ``*_cents`` column to ``*_pkr`` holding units.

    Returns the new frame and the money labels in column order. The labels
    come from the schema, so they are also right for an empty result.
    Two result columns of one name are refused.
    """
    names = df.columns
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise ValueError(f"duplicate result column names: {dupes}")
    labels: list[str] = []
    cols = []
    for n in names:
        if n.endswith(CENTS_SUFFIX):
            label = n[: -len(CENTS_SUFFIX)] + UNITS_SUFFIX
            cols.append(cents_to_units(F.col(n)).alias(label))
            if label not in labels:
                labels.append(label)
        else:
            cols.append(F.col(n))
    return df.select(*cols), labels
