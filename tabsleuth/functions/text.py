"""Analyzers (R1), token counting (SC17) and query-text filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns of the two analyzers and of the token counter.
WORD_PATTERN = r"[\p{L}\p{N}]+"
COUNT_PATTERN = r"\w+|[^\w\s]"


def tokenize(text: Column, analyzer: str = "word") -> Column:
    """``compat`` = whitespace split, case kept (the BM25 default of the
    reference's library); ``word`` = lower-cased runs of letters / digits."""
    if analyzer == "compat":
        parts = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
        return F.filter(parts, lambda t: t != "")
    if analyzer == "word":
        return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 0)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def sql_tokenize(x: str, analyzer: str = "word") -> str:
    """DuckDB twin of :func:`tokenize` for the oracle SQL."""
    if analyzer == "compat":
        return f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda t: t <> '')"
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def strip_ws(c: Column) -> Column:
    """``str.strip()``: leading and trailing whitespace of any kind (Spark's
    ``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sql_strip(x: str) -> str:
    """DuckDB twin of :func:`strip_ws`."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def token_count(text: Column) -> Column:
    """SC17: default token counter, words and single punctuation marks; '' -> 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(COUNT_PATTERN), 0)), F.lit(0))


# Fixed value: what float() accepts, anchored.
NUMERIC_QUERY_PATTERN = (r"^\s*[+-]?((\d(_?\d)*)(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?\s*$"
                         r"|^\s*[+-]?(?i:nan|inf|infinity)\s*$")


def is_numeric_text(text: Column) -> Column:
    """True where ``float(text)`` would succeed."""
    return text.rlike(NUMERIC_QUERY_PATTERN)


def clean_queries(queries: Column, remove_numeric: bool = False) -> Column:
    """F5 (+F4): strip, drop blanks (and numbers), keep first occurrences in order."""
    q = F.filter(F.transform(queries, lambda s: strip_ws(s)), lambda s: s != "")
    if remove_numeric:
        q = F.filter(q, lambda s: ~is_numeric_text(s))
    return F.array_distinct(q)
