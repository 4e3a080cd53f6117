"""Batch answers: empty-result test, routes, answer text, name resolution.

Everything works on whole tables of requests at once; there is no loop over
requests on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import fold_ascii, label_text

# Route labels and answer sentences.
ROUTES = ("sql", "rag", "clarify")
ERR_ROUTE = "invalid router response"
NO_RECORDS = "No matching records were found for that request."
MANY_ROWS = " results. See the table below."
COST_NOTE = ("Estimated food cost and gross profit use sample ingredient costs. "
             "Net profit requires operating expenses.")
PLAN_TEXTS = ("sql", "clarification", "reason")
ERR_PLAN_MISSING, ERR_PLAN_JSON, ERR_PLAN_OBJECT = "no plan", "plan is not JSON", "plan is not an object"
CLARIFY_DEFAULT = "Please make the question more specific."
# Topics the data cannot answer (they need a clarification).
UNAVAILABLE_TOPICS = ("net profit", "stock", "waste", "vat", "refund", "customer")
NAME_DISTANCE = 2


def empty_flag(df: DataFrame) -> DataFrame:
    """One row ``is_empty``: no rows, or every value of every row NULL.

    A distributed ``bool_and`` (partial per partition), never a collect.
    """
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit(True).alias("is_empty"))
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in df.columns])
    return df.agg(F.coalesce(F.bool_and(all_null), F.lit(True)).alias("is_empty"))


def route_split(requests: DataFrame, label_col: str = "route") -> DataFrame:
    """Adds ``error`` for labels outside {sql, rag, clarify} (NULL included)."""
    ok = F.coalesce(F.col(label_col).isin(*ROUTES), F.lit(False))
    return requests.withColumn("error", F.when(~ok, F.lit(ERR_ROUTE)))


def routes(requests: DataFrame, label_col: str = "route") -> dict[str, DataFrame]:
    """The three branches (and the refused rows) as separate frames."""
    r = route_split(requests, label_col)
    out = {name: r.where(F.col(label_col) == name).drop("error") for name in ROUTES}
    out["error"] = r.where(F.col("error").isNotNull())
    return out


def parse_plans(plans: DataFrame, column: str = "plan_json") -> DataFrame:
    """``plans`` with sql, clarification, reason, date_spec (JSON text) and ``error`` from the JSON text in ``column``.

    The text is parsed once into a VARIANT, so a malformed plan is a row with
    an error, not a failed job: the plan is missing, is no JSON, is no object,
    or holds a field of the wrong kind (its values are then null). A null or
    absent field is null; a plan may have further fields.
    """
    parsed = plans.withColumn("_v", F.try_parse_json(column))

    def field(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "variant")

    def is_kind(c: Column, *kinds: str) -> Column:
        return F.coalesce(F.schema_of_variant(c).rlike("^(" + "|".join(kinds) + ")"), F.lit(True))

    text = [(n, is_kind(field(n), "VOID", "STRING")) for n in PLAN_TEXTS]
    spec_ok = is_kind(field("date_spec"), "VOID", "OBJECT")
    error = (F.when(F.col(column).isNull(), F.lit(ERR_PLAN_MISSING))
             .when(F.col("_v").isNull(), F.lit(ERR_PLAN_JSON))
             .when(~is_kind(F.col("_v"), "OBJECT"), F.lit(ERR_PLAN_OBJECT)))
    for name, ok in text:
        error = error.when(~ok, F.lit(f"{name} is not text"))
    out = parsed.withColumn("error", error.when(~spec_ok, F.lit("date_spec is not an object")))
    fine = F.col("error").isNull()
    spec = F.when(~F.coalesce(F.is_variant_null(field("date_spec")), F.lit(True)), F.to_json(field("date_spec")))
    return out.select(*plans.columns, *[F.when(fine, F.try_variant_get("_v", f"$.{n}", "string")).alias(n) for n in PLAN_TEXTS],
                      F.when(fine, spec).alias("date_spec"), "error")


def plan_periods(plans: DataFrame, data_range: DataFrame, column: str = "plan_json", reference: str = "reference") -> DataFrame:
    """``parse_plans`` with the period of each plan's date spec: kind, date_start, date_end; ``error`` of the plan or else of its spec."""
    from ledgerline.functions.calendar import resolve_periods

    parsed = parse_plans(plans, column).withColumnRenamed("error", "_plan_error")
    found = resolve_periods(parsed, data_range, "date_spec", reference)
    return found.withColumn("error", F.coalesce("_plan_error", "error")).drop("_plan_error")


def grouped_results(requests: DataFrame, results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per request: its columns, ``row_count``, and the values of its first result row in ``order``.

    ``results`` holds any number of rows per ``key``; one aggregate with
    map-side combining gives the count, the least row and whether every value
    is null (which counts as no rows, as in ``empty_flag``). Requests without
    result rows are kept with row_count 0 and null values.
    """
    values = [c for c in results.columns if c != key]
    empty = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in values])
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])
    g = results.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"), F.bool_and(empty).alias("_empty"))
    return requests.join(g, key, "left").select(
        *[F.col(c) for c in requests.columns], F.when(F.col("_empty"), 0).otherwise(F.coalesce("_n", F.lit(0))).alias("row_count"),
        *[F.col(f"_first.{c}").alias(c) for c in values])


def clarification_split(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans without SQL become clarifications (with a default question)."""
    clar = plans.where(F.col("sql").isNull()).withColumn(
        "clarification", F.coalesce(F.nullif(F.col("clarification"), F.lit("")), F.lit(CLARIFY_DEFAULT)))
    return plans.where(F.col("sql").isNotNull()), clar


def unavailable_topic(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """Requests that ask for a topic the data does not hold, with that topic
    (the first one in the fixed list order). Topics are whole words, a plural s included. No join."""
    def asked(topic):
        return F.col(text_col).rlike(r"(?i)\b" + topic.replace(" ", r"\s+") + r"s?\b")

    topic = F.coalesce(*[F.when(asked(x), F.lit(x)) for x in UNAVAILABLE_TOPICS])
    return requests.withColumn("topic", topic).where(F.col("topic").isNotNull())


def _value_text(c: Column, money: bool) -> Column:
    if money:
        return F.coalesce(F.format_number(c.cast("double"), 2), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit("None"))


def answer_text(results: DataFrame, key: str, money_labels: list[str],
                period_start: str | None = None, period_end: str | None = None,
                row_count: str | None = None) -> DataFrame:
    """(key, answer) from one result row per key.

    ``results`` holds one row per request (``key``) with its result columns;
    ``row_count`` (optional) is the number of result rows the request had:
    0 -> fixed sentence, 1 -> ``Label: value`` lines, more -> "Found n results".
    A request whose values are all NULL counts as having no rows. Money
    columns use thousands separators and two decimals. With a period, the
    answer starts with ``Period: a to b``; a note follows when a column name
    holds ``cost`` or ``profit``.
    """
    skip = {key, period_start, period_end, row_count}
    cols = [c for c in results.columns if c not in skip]
    lines = [F.concat(label_text(F.lit(c)), F.lit(": "), _value_text(F.col(c), c in money_labels)) for c in cols]
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols]) if cols else F.lit(True)
    n = F.col(row_count) if row_count else F.lit(1)
    body = (F.when((n == 0) | all_null, F.lit(NO_RECORDS))
            .when(n == 1, F.concat_ws("\n\n", *lines))
            .otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(MANY_ROWS))))
    if period_start and period_end:
        prefix = F.when(F.col(period_start).isNotNull(),
                        F.concat(F.lit("Period: "), F.col(period_start).cast("string"), F.lit(" to "),
                                 F.col(period_end).cast("string"), F.lit("\n\n")))
        body = F.concat(F.coalesce(prefix, F.lit("")), body)
    if any("cost" in c or "profit" in c for c in cols):
        body = F.when(n > 0, F.concat(body, F.lit("\n\n" + COST_NOTE))).otherwise(body)
    return results.select(key, body.alias("answer"))


def _piece(i: int, length: Column, pieces: int) -> tuple[Column, Column]:
    """(0-based start, length) of piece ``i`` of a name cut into ``pieces`` nearly equal parts."""
    lo = F.floor(length * i / pieces).cast("int")
    return lo, F.floor(length * (i + 1) / pieces).cast("int") - lo


def _close_names(req: DataFrame, cat: DataFrame, distance: int) -> DataFrame:
    """(_key, candidate) within the edit distance, by shared pieces.

    A name cut into ``distance + 1`` pieces keeps one of them unchanged under
    ``distance`` edits, shifted by at most ``distance``. Requests are cut the
    way a name of each possible length would be; one equi-join on (length,
    piece, text) finds all candidates, the distance is checked on those.
    """
    n = distance + 1
    own = []
    for i in range(n):
        lo, size = _piece(i, F.col("_len"), n)
        own.append(F.struct(F.lit(i).alias("i"), F.substring(F.col("_fold"), lo + 1, size).alias("p")))
    names = cat.withColumn("_len", F.length("_fold")).select("candidate", "_fold", "_len", F.inline(F.array(*own)))
    lengths = F.sequence(F.greatest(F.length("_rfold") - distance, F.lit(0)), F.length("_rfold") + distance)
    r = req.select("_key", "_rfold", F.explode(lengths).alias("_len"))
    cuts = []
    for i in range(n):
        lo, size = _piece(i, F.col("_len"), n)
        for shift in range(-distance, distance + 1):
            cuts.append(F.struct(F.lit(i).alias("i"), F.when(lo + shift >= 0, F.substring(
                F.col("_rfold"), lo + shift + 1, size)).alias("p")))
    r = r.select("_key", "_rfold", "_len", F.inline(F.array(*cuts))).where("p IS NOT NULL").distinct()
    return (r.join(names, ["_len", "i", "p"]).select("_key", "_rfold", "candidate", "_fold").distinct()
            .where(F.levenshtein(F.col("_rfold"), F.col("_fold"), distance) >= 0).select("_key", "candidate"))


def _containing_names(req: DataFrame, cat: DataFrame) -> DataFrame:
    """(_key, candidate): names that hold the request as whole words, found by the request's rarest word."""
    names = cat.select("candidate", "_fold", F.explode(F.array_distinct(F.split("_fold", " "))).alias("_w"))
    uses = names.groupBy("_w").agg(F.count(F.lit(1)).alias("_n"))
    asked = req.select("_key", "_rfold", F.explode(F.array_distinct(F.split("_rfold", " "))).alias("_w"))
    rarest = (asked.join(uses, "_w", "left").groupBy("_key", "_rfold")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_w")).alias("_r")).select("_key", "_rfold", "_r._w"))
    padded = F.instr(F.concat(F.lit(" "), F.col("_fold"), F.lit(" ")),
                     F.concat(F.lit(" "), F.col("_rfold"), F.lit(" "))) > 0
    return rarest.join(names, "_w").where(padded).select("_key", "candidate")


def catalog_candidates(requests: DataFrame, catalog: DataFrame, request_col: str = "name",
                       catalog_col: str = "name", key: str = "request_id",
                       distance: int = NAME_DISTANCE) -> DataFrame:
    """(key, candidate, match_level) for every catalog name that matches a request.

    Levels (the lowest one that applies is kept per pair):
      1 equal ignoring ASCII case;
      2 the catalog name contains the request as whole words;
      3 edit distance <= ``distance`` (on the folded names).
    All matching is by equi-joins -- on the folded name, on the request's
    rarest word, on shared pieces -- never a request x catalog product.
    """
    cat = (catalog.select(F.col(catalog_col).alias("candidate")).distinct()
           .withColumn("_fold", fold_ascii(F.col("candidate"))))
    req = (requests.select(F.col(key).alias("_key"), F.col(request_col).alias("_req"))
           .withColumn("_rfold", fold_ascii(F.col("_req"))))
    exact = req.join(cat, req["_rfold"] == cat["_fold"]).select("_key", "candidate", F.lit(1).alias("_lvl"))
    contains = _containing_names(req, cat).withColumn("_lvl", F.lit(2))
    near = _close_names(req, cat, distance).withColumn("_lvl", F.lit(3))
    return (exact.unionByName(contains).unionByName(near)
            .groupBy("_key", "candidate").agg(F.min("_lvl").alias("match_level"))
            .withColumnRenamed("_key", key))


def name_choices(requests: DataFrame, catalog: DataFrame, request_col: str = "name",
                 catalog_col: str = "name", key: str = "request_id", distance: int = NAME_DISTANCE) -> DataFrame:
    """(key, candidate): one row per catalog name at the best level that a request has."""
    cands = catalog_candidates(requests, catalog, request_col, catalog_col, key, distance)
    best = cands.groupBy(key).agg(F.min("match_level").alias("_best"))
    return cands.join(best, key).where(F.col("match_level") == F.col("_best")).select(key, "candidate")


def resolve_names(requests: DataFrame, catalog: DataFrame, request_col: str = "name",
                  catalog_col: str = "name", key: str = "request_id", distance: int = NAME_DISTANCE) -> DataFrame:
    """Match loosely written names against a catalog of names.

    status: ``resolved`` (exactly one candidate at the best level that has
    any), ``ambiguous`` (several: ``n_choices`` of them, none is picked; their
    rows are ``name_choices``) or ``unknown``.
    """
    g = name_choices(requests, catalog, request_col, catalog_col, key, distance).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("candidate").alias("_c"))
    req = requests.select(F.col(key), F.col(request_col))
    return req.join(g, key, "left").select(
        key, request_col,
        F.when(F.col("_n").isNull(), F.lit("unknown"))
        .when(F.col("_n") == 1, F.lit("resolved")).otherwise(F.lit("ambiguous")).alias("status"),
        F.when(F.col("_n") == 1, F.col("_c")).alias("resolved_name"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_choices"),
    )
