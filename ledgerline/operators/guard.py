"""Guarded, parameterised, read-only SELECT over an allow-list of tables, with a work budget.

``spark.sql`` runs DDL and commands at once, so nothing reaches it before the
text is one SELECT statement whose parse tree, made by Spark's own parser,
consists of listed nodes only: plain relations, listed operators and
expressions, listed functions. What the list does not know is refused, so a
construct that this module has never heard of (names computed at analysis,
table functions, scripts, hints) does not pass.

The statement is then analysed in a fresh session (``newSession``) that holds
only the allowed tables as temporary views, with SQL-on-files disabled, and
the *analysed* plan is checked again: its leaves have to be those views, its
operators and expressions listed ones. The views' own plans are trusted.

Work budget: ``work`` estimates what the optimised plan reads and produces in
bytes (a join without equal keys counts as the product of its sides), and a
query above its budget is refused before any task starts; ``deadline`` tags
the jobs of a block and cancels them when their time is over.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.money import money_columns

PERIOD_PARAMS = frozenset({"date_start", "date_end"})
MAX_STATEMENTS = 10_000

ONE_SELECT = re.compile(r"\s*(select\b[^;]*?)\s*;?\s*", re.IGNORECASE | re.DOTALL)

# Functions that a guarded query may call.
FUNCTIONS = frozenset("""
count sum avg mean min max median mode stddev stddev_pop stddev_samp variance var_pop var_samp corr percentile
percentile_approx approx_count_distinct count_if bool_and bool_or every some any first last first_value last_value any_value
max_by min_by grouping grouping_id row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value
abs ceil ceiling floor round bround sign signum sqrt cbrt exp ln log log10 log2 pow power mod pmod greatest least div
lower upper lcase ucase length char_length character_length trim ltrim rtrim btrim substr substring left right lpad rpad
concat concat_ws replace instr locate position contains startswith endswith split_part initcap reverse translate repeat
like rlike regexp regexp_like format_number ascii levenshtein
coalesce nullif nvl nvl2 ifnull if isnull isnotnull nullifzero zeroifnull
year quarter month day dayofmonth dayofweek weekday dayofyear weekofyear hour minute second last_day date_add dateadd
date_sub datediff date_diff add_months months_between trunc date_trunc date_format to_date date make_date next_day
date_part extract current_date int bigint double float decimal string boolean between
""".split())

# Nodes that the parser may give for a guarded query ...
PARSED = frozenset("""
Project Filter Aggregate Join SubqueryAlias UnresolvedRelation OneRowRelation Union Except Intersect Distinct Sort
GlobalLimit LocalLimit Offset UnresolvedHaving UnresolvedSubqueryColumnAliases
Alias UnresolvedAlias UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedOrdinal NamedParameter Literal Cast
And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual In InSubquery ListQuery Exists
ScalarSubquery IsNull IsNotNull IsTrue IsNotTrue IsFalse IsNotFalse Like ILike RLike CaseWhen Between
Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat Substring StringTrim StringTrimLeft
StringTrimRight StringLocate Extract CurrentDate SortOrder WindowExpression WindowSpecDefinition UnspecifiedFrame
SpecifiedWindowFrame CurrentRow UnboundedPreceding UnboundedFollowing Rollup Cube GroupingSets
""".split())
# ... and nodes that the analyser makes of them, besides the functions' own expressions.
ANALYSED = frozenset("""
Project Filter Aggregate Join SubqueryAlias OneRowRelation Union Except Intersect Distinct Sort GlobalLimit LocalLimit
Offset Window Expand View
AttributeReference OuterReference AggregateExpression Count Sum Average Max Min GetStructField
TimestampAdd DatePart BoolAnd BoolOr Percentile PercentileCont ApproximatePercentile HyperLogLogPlusPlus
DateAddInterval DateAddYMInterval TimestampAddYMInterval SubtractDates If Coalesce
With CommonExpressionDef CommonExpressionRef TypedNullLiteral ExtractANSIIntervalDays KnownNullable KnownNotNull CheckOverflow Year Quarter Month DayOfMonth DayOfWeek WeekDay DayOfYear WeekOfYear Hour Minute
Second RoundCeil RoundFloor TimestampDiff EulerNumber StringLPad Mode Collate ResolvedCollation Empty2Null BaseGroupingSets Grouping GroupingID ShiftRight BitwiseAnd
""".split()) | PARSED - {"UnresolvedRelation", "UnresolvedFunction", "UnresolvedAttribute", "UnresolvedAlias", "UnresolvedStar",
                         "UnresolvedOrdinal", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "NamedParameter"}


class GuardError(ValueError):
    """The SQL text, its parameters or its work were refused."""


def check_text(sql) -> str:
    """The statement of a text that is one SELECT; a semicolon may only end it (none inside, literals included)."""
    found = ONE_SELECT.fullmatch(sql) if isinstance(sql, str) else None
    if found is None:
        raise GuardError("expected the text of a single SELECT statement")
    return found.group(1)


# ---- walking plans --------------------------------------------------------------

PLAN = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"
SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _is(node, class_name: str) -> bool:
    return node.getClass().forName(class_name).isInstance(node)


def _tree(plan, below: Callable[[object], bool] = lambda node: True) -> Iterator:
    """Every plan and expression node, subqueries included; nothing under a node that ``below`` denies."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        if not below(node):
            continue
        stack += _items(node.children())
        if _is(node, PLAN):
            stack += _items(node.expressions())
        elif _is(node, SUBQUERY):
            stack.append(node.plan())


def inspect(session: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """(relations, parameters) that a statement names, lower-cased; refuses every node that is not listed."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    relations, params = set(), set()
    for node in _tree(plan):
        kind = _kind(node)
        if kind not in PARSED:
            raise GuardError(f"not allowed in a guarded query: {kind}")
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1:
                raise GuardError(f"qualified relation name: {'.'.join(parts)}")
            relations.add(parts[0].lower())
        elif kind == "UnresolvedFunction":
            parts = _items(node.nameParts())
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise GuardError(f"function not allowed: {'.'.join(parts)}")
        elif kind == "NamedParameter":
            params.add(node.name())
    return relations, params


def _function_nodes(session: SparkSession) -> set[str]:
    """Names of the expressions behind FUNCTIONS, as Spark's registry states them."""
    state = session._jsparkSession.sessionState()
    out = set()
    for name in FUNCTIONS:
        if state.catalog().isBuiltinFunction(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)):
            info = state.catalog().lookupFunctionInfo(session._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
            out.add(info.getClassName().split(".")[-1].rstrip("$").removesuffix("ExpressionBuilder"))
    return out


def check_analysed(session: SparkSession, df: DataFrame, allowed: set[str]) -> None:
    """Refuse an analysed plan that reads anything but the views ``allowed`` or holds an unlisted node."""
    known = ANALYSED | _function_nodes(session)
    for node in _tree(df._jdf.queryExecution().analyzed(), below=lambda n: _kind(n) != "View"):
        kind = _kind(node)
        if kind not in known:
            raise GuardError(f"not allowed in a guarded query: {kind}")
        if kind == "View":
            name = node.desc().identifier()
            if not node.isTempView() or name.database().isDefined() or name.table().lower() not in allowed:
                raise GuardError(f"view outside the allow-list: {name.table()}")


# ---- work budget ------------------------------------------------------------------

def work(df: DataFrame) -> int:
    """Bytes that the optimised plan is estimated to read and to hand from operator to operator.

    A leaf counts its statistics, an operator at most its child, a join with
    equal keys the sum of its sides, one without them all pairs of rows.
    """
    keys = df.sparkSession._jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    subqueries = []

    def rows(plan, size: int) -> int:
        return -(-size // max(1, plan.schema().defaultSize()))

    def visit(plan) -> tuple[int, int]:
        for e in _items(plan.expressions()):
            subqueries.extend(x.plan() for x in _tree(e, below=lambda n: not _is(n, SUBQUERY)) if _is(x, SUBQUERY))
        inner = [visit(c) for c in _items(plan.children())]
        spent = sum(w for w, _ in inner)
        if not inner:
            size = int(plan.stats().sizeInBytes())
        elif _kind(plan) == "Join" and not keys.unapply(plan).isDefined():
            left, right = _items(plan.children())
            size = rows(left, inner[0][1]) * rows(right, inner[1][1]) * (left.schema().defaultSize() + right.schema().defaultSize())
        else:
            size = sum(s for _, s in inner)
        return spent + size, size

    total = visit(df._jdf.queryExecution().optimizedPlan())[0]
    while subqueries:
        total += visit(subqueries.pop())[0]
    return total


def check_work(df: DataFrame, budget: int | None) -> None:
    if budget is not None:
        needed = work(df)
        if needed > budget:
            raise GuardError(f"over budget: {needed} of {budget} bytes")


@contextmanager
def deadline(spark: SparkSession, seconds: float):
    """Jobs started inside the block are cancelled ``seconds`` after its start; the block then raises GuardError."""
    sc, tag, late = spark.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise GuardError(f"over budget: stopped after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    if late.is_set():
        raise GuardError(f"over budget: stopped after {seconds} seconds")


# ---- guarded queries ----------------------------------------------------------------

def _sandbox(spark: SparkSession, tables: Callable[[SparkSession], dict[str, DataFrame]]) -> tuple[SparkSession, set[str]]:
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    allowed = tables(session)
    for name, df in allowed.items():
        df.createOrReplaceTempView(name)
    return session, {n.lower() for n in allowed}


def _admitted(session: SparkSession, allowed: set[str], sql, params: dict | None, period: dict | None,
              budget: int | None) -> DataFrame:
    text = check_text(sql)
    relations, named = inspect(session, text)
    bound = dict(params or {})
    if period:
        if not PERIOD_PARAMS <= named:
            raise GuardError(f"a query for a period must use {' and '.join(sorted(':' + p for p in PERIOD_PARAMS))}")
        bound |= {"date_start": period["start"], "date_end": period["end"]}
    unknown = sorted(relations - allowed)
    if unknown:
        raise GuardError(f"relations outside the allow-list: {unknown}")
    df = session.sql(text, args=bound or None)
    check_analysed(session, df, allowed)
    check_work(df, budget)
    return df


def guarded_select(spark: SparkSession, sql, tables: Callable[[SparkSession], dict[str, DataFrame]],
                   params: dict | None = None, period: dict | None = None, budget: int | None = None) -> tuple[DataFrame, list[str]]:
    """Run one caller SELECT safely; returns (frame with money in units, money labels).

    ``tables(session)`` builds the allowed tables inside the sandbox session.
    ``period`` (``{'start', 'end'}``) binds ``:date_start``/``:date_end``; a
    query for a period has to use both. ``budget`` (bytes, see ``work``) admits
    or refuses the plan. Every row of the result is returned; wrap the action
    in ``deadline`` to bound its time.
    """
    session, allowed = _sandbox(spark, tables)
    return money_columns(_admitted(session, allowed, sql, params, period, budget))


def screen(statements: DataFrame, tables: Callable[[SparkSession], dict[str, DataFrame]], column: str = "sql",
           params: dict | None = None, budget: int | None = None) -> DataFrame:
    """``statements`` with ``verdict`` (allowed, refused, over budget) for each text; nothing is run.

    Parsing and analysing are work of the driver, so the distinct texts are
    taken there, at most MAX_STATEMENTS; the rows are joined by text.
    """
    spark = statements.sparkSession
    texts = [r[0] for r in statements.select(column).distinct().limit(MAX_STATEMENTS + 1).collect()]
    if len(texts) > MAX_STATEMENTS:
        raise GuardError(f"more than {MAX_STATEMENTS} different statements")
    session, allowed = _sandbox(spark, tables)
    verdicts = []
    for text in texts:
        try:
            _admitted(session, allowed, text, params, None, budget)
            verdicts.append((text, "allowed"))
        except Exception as e:
            verdicts.append((text, "over budget" if isinstance(e, GuardError) and str(e).startswith("over budget") else "refused"))
    found = spark.createDataFrame(verdicts, "_text string, verdict string")
    return statements.join(F.broadcast(found), F.col(column).eqNullSafe(F.col("_text"))).drop("_text")
