import datetime as dt
import json

import pytest

from ledgerline.functions import calendar as C

REF = dt.date(2026, 10, 5)  # a Monday


def _resolve_many(spark, specs, reference=REF, lo="2025-01-01", hi="2027-12-31"):
    rows = [(i, None if s is None else (s if isinstance(s, str) else json.dumps(s)), reference)
            for i, s in enumerate(specs)]
    req = spark.createDataFrame(rows, "i int, spec string, reference date")
    rng = spark.createDataFrame([(dt.date.fromisoformat(lo), dt.date.fromisoformat(hi))],
                                "first_date date, last_date date")
    out = {r["i"]: r for r in C.resolve_periods(req, rng).collect()}
    return [out[i] for i in range(len(specs))]


def test_golden_reference_dates(spark):
    a, b, c = _resolve_many(spark, [{"kind": "relative_day", "offset": -1},
                                    {"kind": "relative_day", "offset": -2},
                                    {"kind": "weekday", "weekday": 6, "direction": "previous", "occurrence": 2}])
    assert a["date_start"] == a["date_end"] == dt.date(2026, 10, 4)
    assert b["date_start"] == dt.date(2026, 10, 3)
    assert c["date_start"] == c["date_end"] == dt.date(2026, 9, 27)


def _brute_weekday(ref, wd, direction, occ):
    step = -1 if direction == "previous" else 1
    d, found = ref, 0
    while True:
        d = d + dt.timedelta(days=step)
        if d.weekday() == wd:
            found += 1
            if found == occ:
                return d


def test_weekday_against_day_by_day_stepping(spark):
    cases = []
    for ref_off in range(7):
        for wd in range(7):
            for direction in ("previous", "next"):
                for occ in (1, 2, 5):
                    cases.append((REF + dt.timedelta(days=ref_off), wd, direction, occ))
    rows = [(i, json.dumps({"kind": "weekday", "weekday": wd, "direction": d, "occurrence": o}), r)
            for i, (r, wd, d, o) in enumerate(cases)]
    req = spark.createDataFrame(rows, "i int, spec string, reference date")
    rng = spark.createDataFrame([(None, None)], "first_date date, last_date date")
    got = {r["i"]: r["date_start"] for r in C.resolve_periods(req, rng).collect()}
    for i, (r, wd, d, o) in enumerate(cases):
        assert got[i] == _brute_weekday(r, wd, d, o), (r, wd, d, o)


def test_same_weekday_is_excluded(spark):
    prev, nxt = _resolve_many(spark, [{"kind": "weekday", "weekday": 0, "direction": "previous"},
                                      {"kind": "weekday", "weekday": 0, "direction": "next"}])
    assert prev["date_start"] == REF - dt.timedelta(days=7)
    assert nxt["date_start"] == REF + dt.timedelta(days=7)


@pytest.mark.parametrize("spec,error", [
    ({"kind": "weekday", "weekday": 1, "direction": "previous", "occurrence": 1}, None),
    ({"kind": "weekday", "weekday": 1, "direction": "previous", "occurrence": 52}, None),
    ({"kind": "weekday", "weekday": 1, "direction": "previous", "occurrence": 0}, C.ERR_WEEKDAY),
    ({"kind": "weekday", "weekday": 1, "direction": "previous", "occurrence": 53}, C.ERR_WEEKDAY),
    ({"kind": "weekday", "weekday": -1, "direction": "previous"}, C.ERR_WEEKDAY),
    ({"kind": "weekday", "weekday": 6, "direction": "previous"}, None),
    ({"kind": "weekday", "weekday": 7, "direction": "previous"}, C.ERR_WEEKDAY),
    ({"kind": "weekday", "weekday": 2, "direction": "sideways"}, C.ERR_DIRECTION),
    ({"kind": "weekday", "weekday": 2}, C.ERR_FIELD),
    ({"kind": "weekday", "weekday": 1.5, "direction": "next"}, C.ERR_WEEKDAY),
    ({"kind": "relative_day", "offset": 3660}, None),
    ({"kind": "relative_day", "offset": -3660}, None),
    ({"kind": "relative_day", "offset": 3661}, C.ERR_OFFSET),
    ({"kind": "relative_day", "offset": -2147483648}, C.ERR_OFFSET),
    ({"kind": "weekday", "weekday": 2, "direction": "next", "occurrence": 2000000000}, C.ERR_WEEKDAY),
    ({"kind": "weekday", "weekday": 2, "direction": "next", "occurrence": -2147483648}, C.ERR_WEEKDAY),
    ({"kind": "relative_day", "offset": True}, C.ERR_OFFSET),
    ({"kind": "relative_day", "offset": 1.5}, C.ERR_OFFSET),
    ({"kind": "relative_day"}, C.ERR_FIELD),
    ({"kind": "month", "year": 2024, "month": 13}, C.ERR_FIELD),
    ({"kind": "range", "start": "2026-06-02", "end": "2026-06-01"}, C.ERR_ORDER),
    ({"kind": "date", "date": "20260601"}, C.ERR_FIELD),
    ({"kind": "date", "date": "2026-02-30"}, C.ERR_FIELD),
    ({"kind": "fortnight"}, C.ERR_KIND),
    ({"kind": "none"}, None),
    ({}, None),
    (None, None),
])
def test_errors(spark, spec, error):
    (r,) = _resolve_many(spark, [spec])
    assert r["error"] == error


def test_calendar_kinds(spark):
    feb24, feb26, year, rng, one, all_, none = _resolve_many(spark, [
        {"kind": "month", "year": 2024, "month": 2}, {"kind": "month", "year": 2026, "month": 2},
        {"kind": "year", "year": 2025}, {"kind": "range", "start": "2026-06-01", "end": "2026-06-01"},
        {"kind": "date", "date": "2026-06-01"}, {"kind": "all"}, {"kind": "none"}])
    assert (feb24["date_start"], feb24["date_end"]) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert feb26["date_end"] == dt.date(2026, 2, 28)
    assert (year["date_start"], year["date_end"]) == (dt.date(2025, 1, 1), dt.date(2025, 12, 31))
    assert rng["date_start"] == rng["date_end"] == dt.date(2026, 6, 1)
    assert one["date_start"] == dt.date(2026, 6, 1)
    assert (all_["date_start"], all_["date_end"]) == (dt.date(2025, 1, 1), dt.date(2027, 12, 31))
    assert none["kind"] == "none" and none["date_start"] is None and none["error"] is None


def test_strict_raises(spark):
    req = spark.createDataFrame([('{"kind": "fortnight"}', REF)], "spec string, reference date")
    rng = spark.createDataFrame([(None, None)], "first_date date, last_date date")
    with pytest.raises(ValueError):
        C.resolve_periods(req, rng, strict=True)
