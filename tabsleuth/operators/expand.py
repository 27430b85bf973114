"""Query expansion (L1, L2, F4, F5, J10, SC22).

The reference asks a model for column names and cell keywords once per
question.  The built-in expansion function takes the keywords that are
literally contained in the question: question n-grams equi-joined with the
distinct cell values of the corpus (cell queries) and question words joined
with column-name tokens (column queries).  A model-backed function can be
plugged in with the same output schema; the cache keeps its results keyed by
the request identity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD_PATTERN, is_numeric_text

# Fixed value: punctuation stripped from both ends of a question token.
EDGE_PUNCT = r"""^[.,;:!?'"()\[\]]+|[.,;:!?'"()\[\]]+$"""
# Positions order queries first, lengths among those that begin together; no text has 2^32 words.
POSITION = 1 << 32


def question_ngrams(questions: DataFrame, keys: Sequence[str], text_col: str = "question") -> DataFrame:
    """Whitespace tokens (edge punctuation stripped, lower-cased) and all their
    n-grams, up to the whole question: keys..., pos, n, term."""
    toks = F.transform(F.split(F.trim(F.col(text_col)), r"\s+"),
                       lambda t: F.lower(F.regexp_replace(t, EDGE_PUNCT, "")))
    q = questions.select(*keys, F.posexplode(toks).alias("pos", "_first"), toks.alias("_t"))
    q = q.select(*keys, "pos", F.explode(F.sequence(F.lit(1), F.size("_t") - F.col("pos"))).alias("n"), "_t")
    return (q.select(*keys, "pos", "n", F.array_join(F.slice("_t", F.col("pos") + 1, F.col("n")), " ").alias("term"))
            .where(F.col("term") != ""))


def builtin_cell_queries(questions: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L1 (cells) F4 F5: n-grams equal to a categorical cell value
    (case-insensitive); numbers removed; first occurrence kept, in question order."""
    grams = question_ngrams(questions, keys)
    terms = grams.select("term").distinct()
    # Cells are joined to the (small) set of question terms -- AQE broadcasts
    # it when measured small -- and only matching values are de-duplicated,
    # so the corpus' distinct values are never shuffled as a whole.
    matched = (cells.where(~F.col("is_numeric") & F.col("value").isNotNull())
               .select(F.lower(F.trim("value")).alias("term"))
               .join(terms, "term").distinct())
    hits = grams.join(matched, "term", "left_semi")
    hits = hits.where(~is_numeric_text(F.col("term")) & (F.trim("term") != ""))
    return (hits.groupBy(*keys, "term").agg(F.min(F.struct("pos", "n")).alias("_f"))
            .select(*keys, F.lit("cell").alias("kind"), F.col("term").alias("query"),
                    (F.col("_f.pos") * POSITION + F.col("_f.n")).cast("long").alias("query_pos")))


def _stem(c):
    return F.regexp_replace(c, "s$", "")


def builtin_column_queries(questions: DataFrame, cells: DataFrame, keys: Sequence[str],
                           text_col: str = "question") -> DataFrame:
    """L1 (columns): column names sharing a word (plural 's' dropped) with the question; ordered by the first shared word."""
    words = questions.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(F.col(text_col)),
                                                                      F.lit(WORD_PATTERN), 0)).alias("pos", "w"))
    words = words.select(*keys, "pos", _stem(F.col("w")).alias("tok"))
    cols = (cells.select("column_name").distinct()
            .select("column_name", F.explode(F.regexp_extract_all(F.lower("column_name"), F.lit(WORD_PATTERN), 0))
                    .alias("t"))
            .select("column_name", _stem(F.col("t")).alias("tok")).distinct())
    j = words.join(cols, "tok")
    return (j.groupBy(*keys, "column_name").agg(F.min("pos").alias("query_pos"))
            .select(*keys, F.lit("column").alias("kind"), F.col("column_name").alias("query"),
                    F.col("query_pos").cast("long")))


def builtin_expand(questions: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L1: column and cell queries of every question (keys..., kind, query, query_pos)."""
    return builtin_column_queries(questions, cells, keys).unionByName(
        builtin_cell_queries(questions, cells, keys))


CACHE_VERSION = "1"


def request_key(kind: str, prompt, remove_numeric: bool, model: str = "builtin", temperature: float = 0.0,
                top_p: float = 1.0, max_tokens: int | None = None, effort: str | None = None):
    """SC22: identity of an expansion request (sha-256 of a canonical text) with
    everything that can change its answer."""
    settings = [str(remove_numeric).lower(), model, f"{temperature:g}", f"{top_p:g}", str(max_tokens), str(effort)]
    return F.sha2(F.concat_ws("|", F.lit("v" + CACHE_VERSION), F.lit(kind), prompt, *[F.lit(x) for x in settings]), 256)


def cached(requests: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame],
           keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Look requests up by key; compute only the misses; return
    (answers with a from_cache flag, new non-empty cache entries to append).

    requests(keys..., kind, key); cache(key, queries array<string>);
    compute(misses) -> (keys..., kind, queries array<string>)."""
    from ..functions.text import token_count
    usage_cols = [F.lit(None).cast("long").alias("usage_in"), F.lit(None).cast("long").alias("usage_out")]
    if cache is None:
        hit = requests.select("*", F.lit(None).cast("array<string>").alias("queries"), *usage_cols)
    else:
        c = cache if "usage_in" in cache.columns else cache.select("*", *usage_cols)
        hit = requests.join(c.select("key", "queries", "usage_in", "usage_out"), "key", "left")
    # A cache hit replays the usage of the call that produced the entry
    found = hit.where(F.col("queries").isNotNull()).withColumn("from_cache", F.lit(True))
    miss = hit.where(F.col("queries").isNull()).drop("queries", "usage_in", "usage_out")
    fresh = compute(miss.select(*keys, "kind")).join(miss, [*keys, "kind"], "right")
    fresh = fresh.withColumn("queries", F.coalesce("queries", F.array().cast("array<string>"))) \
        .withColumn("from_cache", F.lit(False))
    if "usage_in" not in fresh.columns:
        # estimated usage of a fresh call: prompt in (when given), answer list out
        src = F.col("prompt") if "prompt" in fresh.columns else F.col("key")
        fresh = fresh.withColumn("usage_in", token_count(src).cast("long")) \
            .withColumn("usage_out", token_count(F.array_join("queries", ", ")).cast("long"))
    new_entries = (fresh.where(F.size("queries") > 0).select("key", "queries", "usage_in", "usage_out")
                   .dropDuplicates(["key"]))
    return found.unionByName(fresh.select(*found.columns)), new_entries
