"""Answer-side queries: routes, clarifications, topics, names, answer text, guarded SELECT."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.money import money_columns
from ledgerline.operators import answers as A
from ledgerline.operators import periods, sales
from ledgerline.operators.guard import guarded_select, screen, work
from ledgerline.plans.q_periods import REQUESTS_SQL, event_requests
from ledgerline.plans.registry import register
from ledgerline.sources import roles

# Fixed question templates for derived requests (chosen by props.k % 6).
QUESTIONS = ("What was the net profit", "Show stock levels", "Total sales", "Refunds this month",
             "How many customers ordered", "Revenue by branch")
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# ---- routes (T1) and clarifications (G6) ---------------------------------------

def _route_requests(t):
    c = t.raw("conversations")
    label = (F.when(F.col("turn") % 4 == 0, "sql").when(F.col("turn") % 4 == 1, "rag")
             .when(F.col("turn") % 4 == 2, "clarify").otherwise(F.col("role")))
    return c.select("conv_id", "turn", label.alias("route"))


@register("route_split", """
SELECT conv_id, turn, route,
       CASE WHEN route IN ('sql', 'rag', 'clarify') THEN NULL ELSE 'invalid router response' END AS error
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'rag' WHEN 2 THEN 'clarify' ELSE role END AS route
      FROM conversations) r""", use_roles=False)
def q_route_split(t):
    return A.route_split(_route_requests(t))


@register("route_counts", """
SELECT CASE WHEN route IN ('sql', 'rag', 'clarify') THEN route ELSE 'error' END AS branch, count(*) AS requests
FROM (SELECT CASE turn % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'rag' WHEN 2 THEN 'clarify' ELSE role END AS route
      FROM conversations) r GROUP BY 1""", use_roles=False)
def q_route_counts(t):
    branches = A.routes(_route_requests(t))
    parts = [df.agg(F.count(F.lit(1)).alias("requests")).select(F.lit(name).alias("branch"), "requests")
             for name, df in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("requests") > 0)


PLAN_SCHEMA = T.StructType([
    T.StructField("sql", T.StringType()), T.StructField("clarification", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("date_spec", T.StringType()),
])


def _plans(t):
    """Plans as JSON text derived from events: every third has no SQL."""
    e = t.raw("events")
    k = F.get_json_object("props", "$.k").cast("int")
    plan = F.struct(
        F.when(k % 3 != 0, F.concat(F.lit("SELECT count(*) AS n FROM orders -- "), F.col("event_type")))
        .alias("sql"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, F.concat(F.lit("Which "), F.col("event_type"), F.lit("?"))))
        .alias("clarification"),
        F.col("event_type").alias("reason"),
    )
    return e.select(F.col("event_id").alias("request_id"), F.to_json(plan).alias("plan_json"))


def _parsed_plans(t):
    p = _plans(t)
    return p.select("request_id", F.from_json("plan_json", PLAN_SCHEMA).alias("p")).select("request_id", "p.*")


_PLANS_SQL = """
plans AS (
  SELECT event_id AS request_id,
         CASE WHEN k % 3 <> 0 THEN 'SELECT count(*) AS n FROM orders -- ' || event_type END AS sql,
         CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'Which ' || event_type || '?' END AS clarification,
         event_type AS reason
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)
"""


@register("request_plans", "WITH " + _PLANS_SQL + """
SELECT request_id, sql, clarification, reason, CAST(NULL AS VARCHAR) AS date_spec FROM plans""", use_roles=False)
def q_request_plans(t):
    return _parsed_plans(t)


@register("clarification_split", "WITH " + _PLANS_SQL + f"""
SELECT request_id, COALESCE(NULLIF(clarification, ''), '{A.CLARIFY_DEFAULT}') AS clarification
FROM plans WHERE sql IS NULL""", use_roles=False)
def q_clarification_split(t):
    _, clar = A.clarification_split(_parsed_plans(t))
    return clar.select("request_id", "clarification")


# ---- unavailable topics (T4) ----------------------------------------------------

def _questions(t):
    e = t.raw("events")
    k = F.get_json_object("props", "$.k").cast("int")
    q = F.element_at(F.array(*[F.lit(x) for x in QUESTIONS]), (F.pmod(k, F.lit(len(QUESTIONS))) + 1).cast("int"))
    return e.select(F.col("event_id").alias("request_id"),
                    F.concat(q, F.lit(" for "), F.col("event_type")).alias("text"))


_Q_SQL = "CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 " + " ".join(
    f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUESTIONS)) + " END"


@register("unavailable_topic", f"""
SELECT request_id, text, topic FROM (
  SELECT request_id, text,
         CASE WHEN list_has_any(w, ['net profit', 'net profits']) THEN 'net profit'
              WHEN list_has_any(w, ['stock', 'stocks']) THEN 'stock' WHEN list_has_any(w, ['waste', 'wastes']) THEN 'waste'
              WHEN list_has_any(w, ['vat', 'vats']) THEN 'vat' WHEN list_has_any(w, ['refund', 'refunds']) THEN 'refund'
              WHEN list_has_any(w, ['customer', 'customers']) THEN 'customer' END AS topic
  FROM (SELECT *, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS w
        FROM (SELECT *, string_split(lower(text), ' ') AS ws
              FROM (SELECT event_id AS request_id, ({_Q_SQL}) || ' for ' || event_type AS text FROM events) q) s) l) x
WHERE topic IS NOT NULL""", use_roles=False)
def q_unavailable_topic(t):
    return A.unavailable_topic(_questions(t))


# ---- name resolution (T6) and catalog match (J8) ---------------------------------

def _name_requests(t):
    names = t.products.select("name").distinct()
    v = [
        ("exact", F.upper("name")),
        ("first_word", F.split("name", " ")[0]),
        ("typo", F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)"))),
        ("reversed", F.reverse("name")),
    ]
    parts = [names.select(F.concat(F.lit(tag + ":"), F.col("name")).alias("request_id"), expr.alias("name"))
             for tag, expr in v]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


NAMES_SQL = f"""
nm AS (SELECT DISTINCT name FROM products),
req AS (SELECT DISTINCT * FROM (
  SELECT 'exact:' || name AS request_id, upper(name) AS name FROM nm
  UNION ALL SELECT 'first_word:' || name, split_part(name, ' ', 1) FROM nm
  UNION ALL SELECT 'typo:' || name, substring(name, 1, 1) || substring(name, 3) FROM nm
  UNION ALL SELECT 'reversed:' || name, reverse(name) FROM nm) r),
cat AS (SELECT DISTINCT name AS cand, {FOLD.format('name')} AS f FROM products),
rq AS (SELECT request_id, name, {FOLD.format('name')} AS rf FROM req),
cands AS (
  SELECT rq.request_id, cat.cand,
         CASE WHEN rq.rf = cat.f THEN 1
              WHEN contains(' ' || cat.f || ' ', ' ' || rq.rf || ' ') THEN 2
              WHEN levenshtein(rq.rf, cat.f) <= 2 THEN 3 END AS lvl
  FROM rq, cat),
best AS (SELECT request_id, min(lvl) AS b FROM cands WHERE lvl IS NOT NULL GROUP BY request_id),
top AS (SELECT c.request_id, list_sort(list(DISTINCT c.cand)) AS cs FROM cands c JOIN best USING (request_id)
        WHERE c.lvl = best.b GROUP BY c.request_id)
"""


@register("resolve_names", ",\n" + NAMES_SQL + """
SELECT rq.request_id, rq.name,
       CASE WHEN top.cs IS NULL THEN 'unknown' WHEN len(top.cs) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
       CASE WHEN len(top.cs) = 1 THEN top.cs[1] END AS resolved_name,
       CAST(COALESCE(len(top.cs), 0) AS BIGINT) AS n_choices
FROM rq LEFT JOIN top USING (request_id)""")
def q_resolve_names(t):
    return A.resolve_names(_name_requests(t), t.products.select("name"))


@register("name_choices", ",\n" + NAMES_SQL + """
SELECT request_id, unnest(cs) AS candidate FROM top""")
def q_name_choices(t):
    return A.name_choices(_name_requests(t), t.products.select("name"))


@register("join_catalog_match", ",\n" + NAMES_SQL + """
SELECT request_id, cand AS candidate, lvl AS match_level FROM cands WHERE lvl IS NOT NULL""")
def q_join_catalog_match(t):
    return A.catalog_candidates(_name_requests(t), t.products.select("name"))


# ---- batch answers (T2, T3, T5) ------------------------------------------------

def batch_answers(t):
    """Every derived request answered in one plan: resolve, report, word the answer."""
    from ledgerline.functions.calendar import resolve_periods

    req = resolve_periods(event_requests(t), sales.date_range(t)).drop("spec")
    rng = sales.date_range(t)
    lo, hi = rng.select("first_date").scalar(), rng.select("last_date").scalar()
    no_filter = F.col("kind") == "none"
    req = req.select("request_id", "kind", "error",
                     F.when(no_filter, lo).otherwise(F.col("date_start")).alias("date_start"),
                     F.when(no_filter, hi).otherwise(F.col("date_end")).alias("date_end"),
                     F.when(no_filter, None).otherwise(F.col("date_start")).alias("shown_start"),
                     F.when(no_filter, None).otherwise(F.col("date_end")).alias("shown_end"))
    rep = periods.period_report(t, req.where(F.col("error").isNull()))
    rep, labels = money_columns(rep.drop("kind", "error", "date_start", "date_end"))
    ok = A.answer_text(rep, "request_id", labels, "shown_start", "shown_end")
    bad = req.where(F.col("error").isNotNull()).select(
        "request_id", F.concat(F.lit("The date request could not be resolved: "), F.col("error")).alias("answer"))
    return ok.unionByName(bad)


def _fmt(col: str) -> str:
    return f"COALESCE(format('{{:,.2f}}', {col}), 'None')"


def _txt(col: str) -> str:
    return f"COALESCE(CAST({col} AS VARCHAR), 'None')"


@register("batch_answers", ",\n" + REQUESTS_SQL.strip() + f""",
rng AS (SELECT min(order_date) AS lo, max(order_date) AS hi FROM s_orders),
rq AS (SELECT r.request_id, r.kind, r.error,
              CASE WHEN r.kind = 'none' THEN rng.lo ELSE r.date_start END AS ds,
              CASE WHEN r.kind = 'none' THEN rng.hi ELSE r.date_end END AS de,
              CASE WHEN r.kind = 'none' THEN NULL ELSE r.date_start END AS ss,
              CASE WHEN r.kind = 'none' THEN NULL ELSE r.date_end END AS se
       FROM res r, rng),
daily AS (
  SELECT o.order_date AS day, count(DISTINCT o.order_id) AS orders, sum(i.quantity) AS units,
         sum(i.quantity * i.unit_price_cents) AS rev, sum(i.quantity * i.unit_cost_cents) AS cost,
         sum(i.quantity * (i.unit_price_cents - i.unit_cost_cents)) AS profit
  FROM s_orders o JOIN order_items i USING (order_id) GROUP BY o.order_date),
rep AS (
  SELECT q.request_id, q.ss, q.se, CAST(COALESCE(sum(d.orders), 0) AS BIGINT) AS orders, sum(d.units) AS units,
         round(CAST(sum(d.rev) AS DOUBLE) / 100, 2) AS revenue_pkr,
         round(CAST(sum(d.cost) AS DOUBLE) / 100, 2) AS estimated_food_cost_pkr,
         round(CAST(sum(d.profit) AS DOUBLE) / 100, 2) AS estimated_gross_profit_pkr
  FROM rq q LEFT JOIN daily d ON d.day BETWEEN q.ds AND q.de
  WHERE q.error IS NULL GROUP BY q.request_id, q.ss, q.se)
SELECT request_id,
  COALESCE('Period: ' || CAST(ss AS VARCHAR) || ' to ' || CAST(se AS VARCHAR) || chr(10) || chr(10), '')
  || 'Orders: ' || {_txt('orders')} || chr(10) || chr(10) || 'Units: ' || {_txt('units')} || chr(10) || chr(10)
  || 'Revenue pkr: ' || {_fmt('revenue_pkr')} || chr(10) || chr(10)
  || 'Estimated food cost pkr: ' || {_fmt('estimated_food_cost_pkr')} || chr(10) || chr(10)
  || 'Estimated gross profit pkr: ' || {_fmt('estimated_gross_profit_pkr')}
  || chr(10) || chr(10) || '{A.COST_NOTE}' AS answer
FROM rep
UNION ALL
SELECT request_id, 'The date request could not be resolved: ' || error FROM rq WHERE error IS NOT NULL""")
def q_batch_answers(t):
    return batch_answers(t)


# ---- guarded SELECT (P11, G1-G5) -------------------------------------------------

GUARDED_SQL = """
SELECT o.branch, count(DISTINCT o.order_id) AS orders, sum(i.quantity) AS units,
       sum(i.quantity * i.unit_price_cents) AS revenue_cents
FROM orders o JOIN order_items i ON i.order_id = o.order_id
WHERE o.order_date BETWEEN :date_start AND :date_end
GROUP BY o.branch;"""
GUARD_PERIOD = {"start": "1996-01-01", "end": "1996-12-31"}


@register("guarded_select", f"""
SELECT o.branch, count(DISTINCT o.order_id) AS orders, CAST(sum(i.quantity) AS BIGINT) AS units,
       round(CAST(sum(i.quantity * i.unit_price_cents) AS DOUBLE) / 100, 2) AS revenue_pkr
FROM s_orders o JOIN order_items i ON i.order_id = o.order_id
WHERE o.order_date BETWEEN DATE '{GUARD_PERIOD['start']}' AND DATE '{GUARD_PERIOD['end']}'
GROUP BY o.branch""")
def q_guarded_select(t):
    import datetime as dt
    period = {k: dt.date.fromisoformat(v) for k, v in GUARD_PERIOD.items()}
    df, _labels = guarded_select(t.spark, GUARDED_SQL, lambda s: roles.load(s, t.base).views(), period=period)
    return df


# Statements as requests might bring them (by props.k % 12, ``{et}`` and ``{k}`` filled in) with their verdicts.
STATEMENTS = (
    ("SELECT count(*) AS n FROM orders", "allowed"),
    ("SELECT * FROM identifier('orders')", "refused"),
    ("SELECT identifier('reflect')('java.lang.System', 'getProperty', 'user.home') AS x", "refused"),
    ("SELECT branch, count(*) AS n FROM orders WHERE branch = '{et}' GROUP BY branch", "allowed"),
    ("SELECT count(*) AS n FROM order_items a JOIN order_items b ON a.quantity < b.quantity", "over budget"),
    ("SELECT * FROM {et}_log", "refused"),
    ("DROP TABLE orders", "refused"),
    ("SELECT o.branch, sum(i.quantity) AS units FROM orders o JOIN order_items i ON i.order_id = o.order_id GROUP BY o.branch", "allowed"),
    ("SELECT {k}; SELECT 2", "refused"),
    ("SELECT name FROM products WHERE EXISTS (SELECT 1 FROM global_temp.orders)", "refused"),
    ("SELECT name, price_cents FROM products ORDER BY price_cents DESC, name LIMIT {k}", "allowed"),
    ("SELECT i.order_id, p.name FROM products p, order_items i WHERE p.price_cents > i.unit_price_cents", "over budget"),
)
# Work admitted for a screened statement, in scans of all tables.
BUDGET_SCANS = 8


def _statements(t):
    k = F.get_json_object("props", "$.k").cast("int")
    texts = F.element_at(F.array(*[F.lit(x) for x, _ in STATEMENTS]), (k % len(STATEMENTS) + 1).cast("int"))
    text = F.replace(F.replace(texts, F.lit("{et}"), F.col("event_type")), F.lit("{k}"), k.cast("string"))
    return t.raw("events").select(F.col("event_id").alias("request_id"), text.alias("sql"))


def _sql_case(parts) -> str:
    return " ".join(f"WHEN {i} THEN '" + x.replace("'", "''") + "'" for i, x in enumerate(parts))


@register("guard_verdicts", f"""
SELECT event_id AS request_id, replace(replace(CASE k % {len(STATEMENTS)} {_sql_case(x for x, _ in STATEMENTS)} END,
         '{{et}}', event_type), '{{k}}', CAST(k AS VARCHAR)) AS sql,
       CASE k % {len(STATEMENTS)} {_sql_case(v for _, v in STATEMENTS)} END AS verdict
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e""", use_roles=False)
def q_guard_verdicts(t):
    budget = BUDGET_SCANS * sum(work(df) for df in t.views().values())
    return screen(_statements(t), lambda s: roles.load(s, t.base).views(), budget=budget)


# ---- plans as they come (S4): some cut off, of the wrong shape or missing ----------

def _raw_plans(t):
    """Plan texts with the date specs of ``event_requests``; by k % 16, some are broken in a stated way."""
    e = event_requests(t).join(_plans(t), "request_id").join(
        t.raw("events").select(F.col("event_id").alias("request_id"), F.get_json_object("props", "$.k").cast("int").alias("k")), "request_id")
    plan, k = F.col("plan_json"), F.col("k") % 16
    whole = F.concat(F.substring(plan, 1, F.length(plan) - 1), F.lit(',"date_spec":'), F.col("spec"), F.lit("}"))
    broken = (F.when(k == 5, F.substring(whole, 1, 20)).when(k == 9, F.lit("[1, 2]")).when(k == 13, F.lit(None))
              .when(k == 3, F.lit('{"sql": 5, "date_spec": {"kind": "all"}}')).when(k == 7, F.lit('{"sql": "SELECT 1", "date_spec": "all"}'))
              .when(k == 11, F.lit('{"sql": null, "extra": [1], "date_spec": null}')))
    return e.select("request_id", "reference", F.when(k.isin(3, 5, 7, 9, 11, 13), broken).otherwise(whole).alias("plan_json"))


RAW_PLANS_SQL = """,
ks AS (SELECT event_id AS request_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 16 AS m FROM events),
outcome AS (
  SELECT p.request_id, r.reference, m IN (3, 5, 7, 9, 13) AS bad, m,
         CASE m WHEN 3 THEN 'sql is not text' WHEN 5 THEN 'plan is not JSON' WHEN 7 THEN 'date_spec is not an object'
                WHEN 9 THEN 'plan is not an object' WHEN 13 THEN 'no plan' END AS plan_error,
         CASE WHEN m NOT IN (3, 5, 7, 9, 11, 13) THEN p.sql END AS sql,
         CASE WHEN m NOT IN (3, 5, 7, 9, 11, 13) THEN p.clarification END AS clarification,
         CASE WHEN m NOT IN (3, 5, 7, 9, 11, 13) THEN p.reason END AS reason,
         m IN (3, 5, 7, 9, 11, 13) AS no_spec, r.kind, r.date_start, r.date_end, r.error
  FROM plans p JOIN ks USING (request_id) JOIN res r USING (request_id))
"""


@register("plan_rows", ",\n" + REQUESTS_SQL.strip() + ",\n" + _PLANS_SQL.strip() + RAW_PLANS_SQL + """
SELECT request_id, sql, clarification, reason, plan_error AS error FROM outcome""")
def q_plan_rows(t):
    return A.parse_plans(_raw_plans(t)).select("request_id", "sql", "clarification", "reason", "error")


@register("plan_periods", ",\n" + REQUESTS_SQL.strip() + ",\n" + _PLANS_SQL.strip() + RAW_PLANS_SQL + """
SELECT request_id, sql, CASE WHEN no_spec THEN 'none' ELSE kind END AS kind,
       CASE WHEN NOT no_spec THEN date_start END AS date_start, CASE WHEN NOT no_spec THEN date_end END AS date_end,
       CASE WHEN no_spec THEN plan_error ELSE error END AS error
FROM outcome""")
def q_plan_periods(t):
    return A.plan_periods(_raw_plans(t), sales.date_range(t)).select("request_id", "sql", "kind", "date_start", "date_end", "error")


# ---- answers from result sets of any size (T2, T5) ------------------------------------

@register("list_answers", ",\n" + REQUESTS_SQL.strip() + f""",
monthly AS (
  SELECT date_trunc('month', o.order_date)::DATE AS month, count(DISTINCT o.order_id) AS orders,
         sum(i.quantity * i.unit_cost_cents) AS cost
  FROM s_orders o JOIN order_items i USING (order_id) GROUP BY 1),
n AS (
  SELECT r.request_id, r.date_start AS ds, r.date_end AS de, count(m.month) AS c, min(m.month) AS month,
         arg_min(m.orders, m.month) AS orders, round(CAST(arg_min(m.cost, m.month) AS DOUBLE) / 100, 2) AS cost_pkr
  FROM res r LEFT JOIN monthly m ON m.month BETWEEN r.date_start AND r.date_end WHERE r.error IS NULL GROUP BY 1, 2, 3)
SELECT request_id,
  COALESCE('Period: ' || CAST(ds AS VARCHAR) || ' to ' || CAST(de AS VARCHAR) || chr(10) || chr(10), '') ||
  CASE WHEN c = 0 THEN '{A.NO_RECORDS}'
       WHEN c = 1 THEN 'Month: ' || strftime(month, '%Y-%m-%d') || chr(10) || chr(10) || 'Orders: ' || {_txt('orders')} || chr(10) || chr(10)
                       || 'Estimated food cost pkr: ' || {_fmt('cost_pkr')}
       ELSE 'Found ' || c || '{A.MANY_ROWS}' END
  || CASE WHEN c > 0 THEN chr(10) || chr(10) || '{A.COST_NOTE}' ELSE '' END AS answer
FROM n""")
def q_list_answers(t):
    """The monthly summary of each request's period: no month, one, or a list."""
    monthly = sales.monthly_summary(t).select(F.to_date(F.concat("month", F.lit("-01"))).alias("month"), "orders", "estimated_food_cost_cents")
    req = q_requests(t)
    rows = periods.period_join(req, monthly, "month").select("request_id", "month", "orders", "estimated_food_cost_cents")
    rows, labels = money_columns(rows)
    return A.answer_text(A.grouped_results(req, rows, "request_id", ["month"]), "request_id", labels, "date_start", "date_end", "row_count")


def q_requests(t):
    from ledgerline.functions.calendar import resolve_periods

    found = resolve_periods(event_requests(t), sales.date_range(t))
    # through a generator, so that the filter stays above what ``error`` was derived from
    row = F.struct("request_id", "date_start", "date_end", "error")
    return found.select(F.inline(F.array(row))).where("error IS NULL").select("request_id", "date_start", "date_end")
