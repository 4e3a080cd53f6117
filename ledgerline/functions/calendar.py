"""Calendar requests resolved to inclusive periods, as column expressions.

A request is a JSON date spec (a tagged union on ``kind``) plus a reference
date. ``resolve`` turns a column of specs into ``kind, date_start, date_end,
error`` for every row at once -- no per-row Python, no exceptions per row:
a bad request becomes an error row.

Kinds: none, all, date, range, relative_day, weekday, year, month.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEC_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("offset", T.IntegerType()),
    T.StructField("weekday", T.IntegerType()),
    T.StructField("direction", T.StringType()),
    T.StructField("occurrence", T.IntegerType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])

# Fixed limits and messages of the resolver.
MAX_OFFSET_DAYS = 3660
MAX_OCCURRENCE = 52
ERR_OFFSET = "invalid day offset"
ERR_WEEKDAY = "invalid weekday request"
ERR_DIRECTION = "unknown weekday direction"
ERR_KIND = "unsupported date request"
ERR_ORDER = "end date is before start date"
ERR_FIELD = "missing or invalid field"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def as_date(v) -> Column:
    if isinstance(v, Column):
        return v.cast("date")
    if isinstance(v, (_dt.date,)):
        return F.lit(v)
    return F.lit(str(v)).cast("date")


def parse_iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text to date; anything else (or an impossible day) is NULL."""
    return F.when(c.rlike(ISO_DATE), F.try_to_date(c, "yyyy-MM-dd"))


def parse_spec(c: Column) -> Column:
    """JSON text to the spec struct (ints given as ``true`` or ``1.5`` become NULL)."""
    return F.from_json(c, SPEC_SCHEMA)


def _safe_make_date(y: Column, m: Column, d: Column) -> Column:
    ok = y.between(1, 9999) & m.between(1, 12)
    return F.when(ok, F.make_date(y, m, d))


def _nz(c: Column) -> Column:
    """NULL-safe condition: NULL counts as false."""
    return F.coalesce(c, F.lit(False))


PRESENCE_KEYS = ("offset", "weekday", "direction", "occurrence")
KINDS = ("all", "date", "range", "relative_day", "weekday", "year", "month")


def resolve_periods(requests: DataFrame, data_range: DataFrame, spec_col: str = "spec",
                    reference_col: str = "reference", strict: bool = False) -> DataFrame:
    """Add ``kind, date_start, date_end, error`` to a table of requests.

    ``spec_col`` holds JSON text; ``data_range`` is the one-row (first_date,
    last_date) of the data, used by kind ``all``; its two values enter the
    plan as scalar subqueries (one row, planned once), not as a join.

    The work is a chain of narrow projections (no shuffle): parse the JSON
    once, flatten it, derive the candidate days, pick start/end, then the
    error. Each step refers to the previous one's columns, so no expression
    is copied into another. ``strict`` raises when any request is in error.
    """
    first = data_range.select("first_date").scalar()
    last = data_range.select("last_date").scalar()
    keep = [F.col(c) for c in requests.columns]
    raw = F.col(spec_col)

    # 1. parse once; note which keys are present (a wrong type parses to NULL).
    # The parsed record leaves through a one-element ``inline`` generator:
    # Catalyst does not push predicates through a generator's output, so a
    # later filter on a derived column stops here instead of copying the
    # JSON parse (and whatever built the JSON) into the filter.
    parsed = F.struct(parse_spec(raw).alias("_s"),
                      *[_nz(F.get_json_object(raw, f"$.{k}").isNotNull()).alias(f"_has_{k}")
                        for k in PRESENCE_KEYS])
    df = requests.select(*keep, F.inline(F.array(parsed)))
    df = df.select(*keep, *[F.col(f"_has_{k}") for k in PRESENCE_KEYS],
                   F.col(reference_col).cast("date").alias("_ref"),
                   *[F.col("_s")[f.name].alias(f"_{f.name}") for f in SPEC_SCHEMA.fields])

    # 2. candidate days per kind
    ref, wd, y, m = F.col("_ref"), F.col("_weekday"), F.col("_year"), F.col("_month")
    occ = F.when(F.col("_has_occurrence"), F.col("_occurrence")).otherwise(F.lit(1))
    # out-of-bounds numbers become null before any arithmetic, which would overflow
    occ = F.when(occ.between(1, MAX_OCCURRENCE), occ)
    offset = F.when(F.col("_offset").between(-MAX_OFFSET_DAYS, MAX_OFFSET_DAYS), F.col("_offset"))
    kind = F.col("_kind")
    df = df.select(
        *keep, *[F.col(f"_has_{k}") for k in PRESENCE_KEYS], "_kind", "_direction", "_offset", "_weekday",
        _nz(kind.isNull() | (kind == "none")).alias("_no_period"),
        _nz(kind.isin(*KINDS)).alias("_known"),
        _nz(wd.between(0, 6) & occ.isNotNull()).alias("_week_ok"),
        offset.isNotNull().alias("_rel_ok"),
        F.date_sub(ref, F.coalesce(F.nullif(F.pmod(F.weekday(ref) - wd, F.lit(7)), F.lit(0)), F.lit(7))
                   + 7 * (occ - 1)).alias("_prev_day"),
        F.date_add(ref, F.coalesce(F.nullif(F.pmod(wd - F.weekday(ref), F.lit(7)), F.lit(0)), F.lit(7))
                   + 7 * (occ - 1)).alias("_next_day"),
        F.date_add(ref, offset).alias("_rel_day"),
        parse_iso_date(F.col("_date")).alias("_one_day"),
        parse_iso_date(F.col("_start")).alias("_r_start"),
        parse_iso_date(F.col("_end")).alias("_r_end"),
        _safe_make_date(y, F.lit(1), F.lit(1)).alias("_y_start"),
        _safe_make_date(y, F.lit(12), F.lit(31)).alias("_y_end"),
        _safe_make_date(y, m, F.lit(1)).alias("_m_start"),
    )

    # 3. start and end of the period
    kind, direction = F.col("_kind"), F.col("_direction")
    week = (kind == "weekday") & F.col("_week_ok")

    def pick(all_day, range_day, year_day, month_day):
        return (F.when(kind == "all", all_day)
                .when(kind == "date", F.col("_one_day"))
                .when(kind == "range", range_day)
                .when((kind == "relative_day") & F.col("_rel_ok"), F.col("_rel_day"))
                .when(week & (direction == "previous"), F.col("_prev_day"))
                .when(week & (direction == "next"), F.col("_next_day"))
                .when(kind == "year", year_day)
                .when(kind == "month", month_day))

    df = df.select(
        *keep, *[F.col(f"_has_{k}") for k in PRESENCE_KEYS], "_kind", "_direction", "_no_period",
        "_known", "_week_ok", "_rel_ok",
        pick(first.cast("date"), F.col("_r_start"), F.col("_y_start"), F.col("_m_start")).alias("_st"),
        pick(last.cast("date"), F.col("_r_end"), F.col("_y_end"), F.last_day("_m_start")).alias("_en"),
    )

    # 4. error, then the visible columns
    st, en = F.col("_st"), F.col("_en")
    error = (F.when(F.col("_no_period"), F.lit(None).cast("string"))
             .when(~F.col("_known"), F.lit(ERR_KIND))
             .when((kind == "relative_day") & ~F.col("_has_offset"), F.lit(ERR_FIELD))
             .when((kind == "relative_day") & ~F.col("_rel_ok"), F.lit(ERR_OFFSET))
             .when((kind == "weekday") & ~(F.col("_has_weekday") & F.col("_has_direction")), F.lit(ERR_FIELD))
             .when((kind == "weekday") & ~F.col("_week_ok"), F.lit(ERR_WEEKDAY))
             .when((kind == "weekday") & ~_nz(direction.isin("previous", "next")), F.lit(ERR_DIRECTION))
             .when(st.isNull() | en.isNull(), F.lit(ERR_FIELD))
             .when(en < st, F.lit(ERR_ORDER)))
    df = df.select(*keep, "_no_period", "_kind", "_st", "_en", error.alias("error"))
    ok = F.col("error").isNull() & ~F.col("_no_period")
    out = df.select(*keep,
                    F.when(F.col("_no_period"), F.lit("none")).otherwise(F.col("_kind")).alias("kind"),
                    F.when(ok, F.col("_st")).alias("date_start"),
                    F.when(ok, F.col("_en")).alias("date_end"),
                    "error")
    if strict:
        bad = out.where(F.col("error").isNotNull()).limit(1).collect()
        if bad:
            raise ValueError(f"request in error: {bad[0]['error']}")
    return out


def resolve_one(spark, spec_json: str | None, reference, data_start=None, data_end=None) -> dict:
    """Resolve a single request (convenience for callers and tests)."""
    import datetime as dt

    ref = reference if isinstance(reference, dt.date) else dt.date.fromisoformat(str(reference))
    req = spark.createDataFrame([(spec_json, ref)], "spec string, reference date")
    rng = spark.createDataFrame(
        [(None if data_start is None else dt.date.fromisoformat(str(data_start)),
          None if data_end is None else dt.date.fromisoformat(str(data_end)))],
        "first_date date, last_date date")
    row = resolve_periods(req, rng).collect()[0]
    return {"kind": row["kind"], "date_start": row["date_start"], "date_end": row["date_end"],
            "error": row["error"]}
