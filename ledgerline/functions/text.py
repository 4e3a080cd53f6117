"""Text column expressions (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII case folding (SQLite NOCASE folds A-Z only).
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = "abcdefghijklmnopqrstuvwxyz"

# Python's str.split() whitespace: Unicode White_Space plus the four
# information separators 0x1c-0x1f. Java's \s is ASCII-only; (?U) widens it.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# A token is a run of letters or digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def fold_ascii(c: Column) -> Column:
    """Fold A-Z to a-z only (``É`` stays ``É``)."""
    return F.translate(c, UPPER_ASCII, LOWER_ASCII)


def normalize_whitespace(c: Column) -> Column:
    """``" ".join(text.split())``: collapse whitespace runs, trim the ends."""
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def tokens(c: Column) -> Column:
    """Lower-cased letter/digit tokens; empty strings removed."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda x: x != "")


def token_text(c: Column) -> Column:
    """The ``tokens`` in order, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(c), TOKEN_SPLIT, " "))


def label_text(c: Column) -> Column:
    """``name.replace('_',' ').capitalize()``: first letter up, the rest down."""
    s = F.regexp_replace(c, "_", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def file_stem(c: Column) -> Column:
    """File name without its last extension (``a/b/c.pdf`` -> ``c``)."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")
