"""Calendar requests: resolution, batch period report, period range join.

Requests are derived from ``events`` so that their number grows with the
data: every event row becomes one JSON date spec plus a reference date.
Binding (ours): ``k`` = props.k; the reference is the event date moved back
324 months (into the years of the order data); the spec kind follows the
event type.

    view      relative_day   offset = k - 50   (x100 when k % 25 = 0: out of bounds)
    click     weekday        weekday = k % 8, direction by k % 3 (previous, next, back),
                             occurrence = k % 54, omitted when k % 4 = 0
    purchase  month          year = 1994 + k % 9, month = k % 14
    signup    year           year = 1993 + k % 10
    error     by k % 6:      all, none, range, date, fortnight, (no kind)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.calendar import resolve_periods
from ledgerline.operators import periods, sales
from ledgerline.plans.registry import register

REF_SHIFT_MONTHS = 324


def event_requests(t):
    e = t.raw("events")
    k = F.get_json_object("props", "$.k").cast("int")
    ref = F.add_months(F.col("ts").cast("date"), -REF_SHIFT_MONTHS)
    et = F.col("event_type")
    err_kind = (F.when(k % 6 == 0, "all").when(k % 6 == 1, "none").when(k % 6 == 2, "range")
                .when(k % 6 == 3, "date").when(k % 6 == 4, "fortnight"))
    kind = (F.when(et == "view", "relative_day").when(et == "click", "weekday")
            .when(et == "purchase", "month").when(et == "signup", "year")
            .when(et == "error", err_kind))
    one = F.date_sub(ref, k * 30)
    spec = F.struct(
        kind.alias("kind"),
        F.when(kind == "date", F.when(k % 12 == 3, F.date_format(one, "yyyy/MM/dd"))
               .otherwise(F.date_format(one, "yyyy-MM-dd"))).alias("date"),
        F.when(kind == "range", F.date_format(F.date_sub(ref, k % 9), "yyyy-MM-dd")).alias("start"),
        F.when(kind == "range", F.date_format(F.date_add(ref, k % 7 - 3), "yyyy-MM-dd")).alias("end"),
        F.when(et == "view", F.when(k % 25 == 0, (k - 50) * 100).otherwise(k - 50)).alias("offset"),
        F.when(et == "click", k % 8).alias("weekday"),
        F.when(et == "click", F.when(k % 3 == 0, "previous").when(k % 3 == 1, "next").otherwise("back"))
        .alias("direction"),
        F.when((et == "click") & (k % 4 != 0), k % 54).alias("occurrence"),
        F.when(et == "purchase", 1994 + k % 9).when(et == "signup", 1993 + k % 10).alias("year"),
        F.when(et == "purchase", k % 14).alias("month"),
    )
    return e.select(F.col("event_id").alias("request_id"), ref.alias("reference"),
                    F.to_json(spec).alias("spec"))


def resolved(t):
    return resolve_periods(event_requests(t), sales.date_range(t)).drop("spec")


REQUESTS_SQL = """
base AS (
  SELECT event_id AS request_id, CAST(CAST(ts AS DATE) - INTERVAL 324 MONTH AS DATE) AS reference,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS et
  FROM events),
spec AS (
  SELECT request_id, reference, k,
    CASE WHEN et = 'view' THEN 'relative_day' WHEN et = 'click' THEN 'weekday'
         WHEN et = 'purchase' THEN 'month' WHEN et = 'signup' THEN 'year'
         WHEN et = 'error' THEN CASE k % 6 WHEN 0 THEN 'all' WHEN 1 THEN 'none' WHEN 2 THEN 'range'
                                           WHEN 3 THEN 'date' WHEN 4 THEN 'fortnight' END END AS kind,
    CASE WHEN et = 'view' THEN CASE WHEN k % 25 = 0 THEN (k - 50) * 100 ELSE k - 50 END END AS off,
    CASE WHEN et = 'click' THEN k % 8 END AS wd,
    CASE WHEN et = 'click' THEN CASE k % 3 WHEN 0 THEN 'previous' WHEN 1 THEN 'next' ELSE 'back' END END AS direction,
    CASE WHEN et = 'click' AND k % 4 <> 0 THEN k % 54 ELSE 1 END AS occ,
    CASE WHEN et = 'purchase' THEN 1994 + k % 9 WHEN et = 'signup' THEN 1993 + k % 10 END AS yr,
    CASE WHEN et = 'purchase' THEN k % 14 END AS mon
  FROM base),
calc AS (
  SELECT *,
    COALESCE(wd BETWEEN 0 AND 6 AND occ BETWEEN 1 AND 52, false) AS week_ok,
    COALESCE(abs(off) <= 3660, false) AS rel_ok,
    reference - CAST(COALESCE(NULLIF((isodow(reference) - 1 - wd + 7) % 7, 0), 7) + 7 * (occ - 1) AS INTEGER) AS prev_day,
    reference + CAST(COALESCE(NULLIF((wd - (isodow(reference) - 1) + 7) % 7, 0), 7) + 7 * (occ - 1) AS INTEGER) AS next_day,
    CASE WHEN kind = 'date' AND k % 12 <> 3 THEN reference - CAST(k * 30 AS INTEGER) END AS one_day,
    CASE WHEN kind = 'range' THEN reference - CAST(k % 9 AS INTEGER) END AS r_start,
    CASE WHEN kind = 'range' THEN reference + CAST(k % 7 - 3 AS INTEGER) END AS r_end,
    CASE WHEN yr BETWEEN 1 AND 9999 THEN make_date(yr, 1, 1) END AS y_start,
    CASE WHEN yr BETWEEN 1 AND 9999 THEN make_date(yr, 12, 31) END AS y_end,
    CASE WHEN yr BETWEEN 1 AND 9999 AND mon BETWEEN 1 AND 12
         THEN make_date(yr, least(greatest(mon, 1), 12), 1) END AS m_start
  FROM spec),
se AS (
  SELECT *,
    CASE kind WHEN 'all' THEN (SELECT min(order_date) FROM s_orders) WHEN 'date' THEN one_day
      WHEN 'range' THEN r_start WHEN 'relative_day' THEN CASE WHEN rel_ok THEN reference + CAST(off AS INTEGER) END
      WHEN 'weekday' THEN CASE WHEN week_ok AND direction = 'previous' THEN prev_day
                               WHEN week_ok AND direction = 'next' THEN next_day END
      WHEN 'year' THEN y_start WHEN 'month' THEN m_start END AS s,
    CASE kind WHEN 'all' THEN (SELECT max(order_date) FROM s_orders) WHEN 'date' THEN one_day
      WHEN 'range' THEN r_end WHEN 'relative_day' THEN CASE WHEN rel_ok THEN reference + CAST(off AS INTEGER) END
      WHEN 'weekday' THEN CASE WHEN week_ok AND direction = 'previous' THEN prev_day
                               WHEN week_ok AND direction = 'next' THEN next_day END
      WHEN 'year' THEN y_end WHEN 'month' THEN last_day(m_start) END AS e
  FROM calc),
err AS (
  SELECT *,
    CASE WHEN kind IS NULL OR kind = 'none' THEN NULL
      WHEN kind NOT IN ('all', 'date', 'range', 'relative_day', 'weekday', 'year', 'month')
        THEN 'unsupported date request'
      WHEN kind = 'relative_day' AND off IS NULL THEN 'missing or invalid field'
      WHEN kind = 'relative_day' AND NOT rel_ok THEN 'invalid day offset'
      WHEN kind = 'weekday' AND (wd IS NULL OR direction IS NULL) THEN 'missing or invalid field'
      WHEN kind = 'weekday' AND NOT week_ok THEN 'invalid weekday request'
      WHEN kind = 'weekday' AND direction NOT IN ('previous', 'next') THEN 'unknown weekday direction'
      WHEN s IS NULL OR e IS NULL THEN 'missing or invalid field'
      WHEN e < s THEN 'end date is before start date' END AS error
  FROM se),
res AS (
  SELECT request_id, reference,
         CASE WHEN kind IS NULL OR kind = 'none' THEN 'none' ELSE kind END AS kind,
         CASE WHEN error IS NULL AND kind IS NOT NULL AND kind <> 'none' THEN s END AS date_start,
         CASE WHEN error IS NULL AND kind IS NOT NULL AND kind <> 'none' THEN e END AS date_end,
         error
  FROM err)
"""


def _with_requests(body: str) -> str:
    return ",\n" + REQUESTS_SQL.strip() + "\n" + body


@register("resolve_periods", _with_requests("SELECT * FROM res"))
def q_resolve_periods(t):
    return resolved(t)


@register("resolve_errors", _with_requests(
    "SELECT request_id, kind, error FROM res WHERE error IS NOT NULL"))
def q_resolve_errors(t):
    return resolved(t).where(F.col("error").isNotNull()).select("request_id", "kind", "error")


@register("period_report", _with_requests(""",
daily AS (
  SELECT o.order_date AS day, count(DISTINCT o.order_id) AS orders, sum(i.quantity) AS units,
         sum(i.quantity * i.unit_price_cents) AS rev, sum(i.quantity * i.unit_cost_cents) AS cost,
         sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)) AS profit
  FROM s_orders o JOIN order_items i USING (order_id) GROUP BY o.order_date)
SELECT r.request_id, r.reference, r.kind, r.date_start, r.date_end, r.error,
       CAST(COALESCE(sum(d.orders), 0) AS BIGINT) AS orders,
       CAST(sum(d.units) AS BIGINT) AS units,
       CAST(sum(d.rev) AS BIGINT) AS revenue_cents,
       CAST(sum(d.cost) AS BIGINT) AS estimated_food_cost_cents,
       CAST(sum(d.profit) AS BIGINT) AS estimated_gross_profit_cents
FROM res r LEFT JOIN daily d ON d.day BETWEEN r.date_start AND r.date_end
GROUP BY r.request_id, r.reference, r.kind, r.date_start, r.date_end, r.error"""))
def q_period_report(t):
    return periods.period_report(t, resolved(t))


@register("join_period", _with_requests("""
SELECT r.request_id, count(*) AS order_days, CAST(sum(o.n) AS BIGINT) AS orders
FROM res r JOIN (SELECT order_date, count(*) AS n FROM s_orders GROUP BY 1) o
  ON o.order_date BETWEEN r.date_start AND r.date_end
GROUP BY 1"""))
def q_join_period(t):
    return periods.orders_in_periods(t, resolved(t))


@register("period_peaks", _with_requests(""",
daily AS (SELECT order_date, count(*) AS n FROM s_orders GROUP BY 1)
SELECT r.request_id, max({'n': d.n, 'd': -(d.order_date - DATE '1970-01-01')}).n AS busiest_orders,
       DATE '1970-01-01' + CAST(-max({'n': d.n, 'd': -(d.order_date - DATE '1970-01-01')}).d AS INTEGER) AS busiest_day,
       min(d.n) AS quietest_orders
FROM res r JOIN daily d ON d.order_date BETWEEN r.date_start AND r.date_end
GROUP BY 1"""))
def q_period_peaks(t):
    return periods.busiest_days(t, resolved(t))


@register("period_days", _with_requests("""
SELECT p.date_start, p.date_end, d.order_date, d.orders
FROM (SELECT DISTINCT date_start, date_end FROM res WHERE date_start IS NOT NULL) p
JOIN (SELECT order_date, count(*) AS orders FROM s_orders GROUP BY 1) d ON d.order_date BETWEEN p.date_start AND p.date_end"""))
def q_period_days(t):
    asked = resolved(t).select("date_start", "date_end").distinct()
    daily = t.orders.groupBy("order_date").agg(F.count(F.lit(1)).alias("orders"))
    return periods.period_join(asked, daily, "order_date")
