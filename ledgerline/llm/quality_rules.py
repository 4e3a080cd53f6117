"""Quality rules: a threshold table compiled into Spark projections.

Every measure is a column expression over one text; the table of thresholds
becomes one boolean per rule. No user function, no shuffle: each row is
judged where it is read, so the cost is linear in the text and the same at
every cluster size.

Repeated three-word windows are found inside a row by sorting one long per
window: the window's hash in the high bits, its position in the low bits.
Neighbours of equal hash are compared word by word; if two of them differ
(a hash collision), the row is evaluated again on the window texts, so the
count is exact.

Defined results: a null or blank text has no words, all measures 0, fails
the base rules and is not kept. Repeated rows are judged alike, one result
row each. Extra columns are ignored by ``judge`` (it keeps them unchanged
and adds its own; a clashing name is replaced by the operator's column).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Symbols counted by the contract.
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in that it is was for on with as he be at by this had not are but from or have an they which "
    "der die und in den von zu das mit sich des auf für im ist nicht dem ein eine als "
    "le la les de des et un une du en que qui dans pour est il elle au par sur pas avec "
    "el los las y lo por con su para una del al se no como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a bound of None does not apply."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


# The threshold table. Ratios are taken over n_words or n_lines.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.06, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("repeat_words", "n_repeat_words", "n_words", None, 0.5),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _covered(starts: Column) -> Column:
    """Number of positions covered by the three-word windows at ``starts`` (sorted)."""
    gaps = F.transform(starts, lambda p, i: F.least(
        F.lit(3).cast("long"), F.coalesce(F.get(starts, i + 1) - p, F.lit(3).cast("long"))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text as long columns (see MEASURES)."""
    df = df.drop(*[c for c in df.columns if c in MEASURES or c.startswith("_q_")])
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    df = df.withColumn("_q_w", words(F.col(text))).withColumn("_q_l", lines)
    df = df.withColumn("n_words", F.size("_q_w").cast("long"))
    w, n = F.col("_q_w"), F.col("n_words").cast("int")
    # One long per window: hash above, start below; `bits` low bits hold any start.
    df = df.withColumn("_q_b", F.coalesce(F.length(F.bin("n_words")), F.lit(1)))
    bits = F.col("_q_b")

    def key(x):
        return _shift("shiftright", x, bits)

    def at(x):
        return (x - _shift("shiftleft", key(x), bits)).cast("int")

    starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    packed = F.sort_array(F.transform(starts, lambda i: _shift(
        "shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))))
    df = df.withColumn("_q_s", F.when(n >= 3, packed).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_q_s")
    df = df.withColumn("_q_d", F.filter(
        s, lambda x, j: (key(F.get(s, j - 1)) == key(x)) | (key(F.get(s, j + 1)) == key(x))))
    d = F.col("_q_d")

    def differs(x, j):
        p, q = at(x), at(F.get(d, j - 1))
        same = ((F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1))
                & (F.get(w, p + 2) == F.get(w, q + 2)))
        return (key(F.get(d, j - 1)) == key(x)) & ~same

    windows = F.array_sort(F.transform(starts, lambda i: F.struct(
        F.concat_ws(" ", F.slice(w, i + 1, 3)).alias("t"), i.cast("long").alias("i"))))
    exact = F.filter(windows, lambda x, j: (
        (F.get(windows, j - 1)["t"] == x["t"]) | (F.get(windows, j + 1)["t"] == x["t"])))
    df = df.withColumn("_q_p", F.sort_array(
        F.when(F.size(F.filter(d, differs)) > 0, F.transform(exact, lambda x: x["i"]))
        .otherwise(F.transform(d, lambda x: at(x).cast("long")))))
    ln = F.col("_q_l")
    stop = sorted(set(STOP_WORDS) | {x.capitalize() for x in STOP_WORDS})
    out = {
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": _covered(F.col("_q_p")),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))),
        "n_lines": F.size(ln),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: x.rlike("^[ \\t]*[-*\\u2022]"))),
        "n_ellipsis_lines": F.size(F.filter(ln, lambda x: x.rlike("(\\.\\.\\.|\\u2026)[ \\t]*$"))),
    }
    return (df.withColumns({k: v.cast("long") for k, v in out.items()})
            .drop("_q_w", "_q_l", "_q_b", "_q_s", "_q_d", "_q_p"))


def rule_passed(rule: Rule) -> Column:
    """True if the rule holds; a denominator of 0 counts as a ratio of 0."""
    ratio = F.when(F.col(rule.denominator) > 0, F.col(rule.numerator) / F.col(rule.denominator)).otherwise(F.lit(0.0))
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (ratio >= rule.low)
    if rule.high is not None:
        ok = ok & (ratio <= rule.high)
    return ok


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the measures, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    df = with_measures(df, text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~rule_passed(r), F.lit(r.name)) for r in rules]))
    return (df.withColumn("base_failed", base).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))
