"""BM25 index build, scoring and top-k.

Index (all corpora at once)::

    postings(corpus_id, token, doc_ord, tf, norm, idf)
    docs_meta(corpus_id, doc_ord)            -- for zero-score padding
    stats(corpus_id, n_docs, avgdl, avg_idf)

Okapi BM25 as in the reference's library: k1=1.5, b=0.75, epsilon=0.25,
idf = ln(N - n + 0.5) - ln(n + 0.5), negative idf replaced by
epsilon * (mean idf over the vocabulary), query tokens counted with
multiplicity, unknown tokens contribute 0.

Scoring is one equi-join of query tokens with postings on
(corpus_id, token).  The query side is usually small: AQE turns the join
into a broadcast join when the measured size is under the threshold and
keeps a sort-merge join (with skew splitting for hot tokens) otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize

# Fixed values of the reference's BM25 variant.
K1 = 1.5
B = 0.75
EPSILON = 0.25

#: A token of at most as many documents is rare: its documents are scored one by one.
RARE_DOCS = 64


def build_index(docs: DataFrame, analyzer: str = "word", corpus_col: str = "corpus_id",
                doc_col: str = "doc_ord", text_col: str = "page_content") -> dict[str, DataFrame]:
    """R2: postings with tf, length norm and idf for every corpus.

    Texts are tokenized once: the document length travels with the
    exploded tokens into the (corpus, doc, token) count, and N comes from an
    id-only scan (empty documents count in N and in the mean length, as in
    the reference).  ``tf`` feeds the vocabulary, the totals and the
    postings through one reused shuffle.
    """
    from ..sources.store import materialize, spread
    ids = docs.select(F.col(corpus_col).alias("corpus_id"), F.col(doc_col).alias("doc_ord"))
    toks = spread(docs).select(F.col(corpus_col).alias("corpus_id"), F.col(doc_col).alias("doc_ord"),
                               tokenize(F.col(text_col), analyzer).alias("toks"))
    # explode_outer: plain explode makes the optimizer push a second copy of
    # the tokenizer into the scan as a filter.  tf is the index's core table:
    # it is written once and read by the totals, the vocabulary and the postings.
    tf = materialize(
        toks.select("corpus_id", "doc_ord", F.size("toks").alias("dl"), F.explode_outer("toks").alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("corpus_id", "doc_ord", "token")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")), "tf")
    n_docs = ids.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n_docs"))
    total = tf.groupBy("corpus_id").agg(F.sum("tf").alias("_tokens"))
    # stats / avg_idf / tail hold one row per corpus (bounded by the number of
    # corpora, not by rows): they are broadcast.  With a single corpus the key
    # folds to a constant and the join is a loop over that one row.
    stats = (n_docs.join(F.broadcast(total), "corpus_id", "left")
             .select("corpus_id", "n_docs", (F.coalesce("_tokens", F.lit(0)) / F.col("n_docs")).alias("avgdl")))
    dfreq = tf.groupBy("corpus_id", "token").agg(F.count(F.lit(1)).alias("df"))
    raw = (dfreq.join(F.broadcast(stats.select("corpus_id", "n_docs")), "corpus_id")
           .withColumn("idf_raw", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)))
    avg_idf = raw.groupBy("corpus_id").agg(F.avg("idf_raw").alias("avg_idf"))
    idf = (raw.join(F.broadcast(avg_idf), "corpus_id")
           .select("corpus_id", "token", "df",
                   F.when(F.col("idf_raw") < 0, EPSILON * F.col("avg_idf"))
                   .otherwise(F.col("idf_raw")).alias("idf")))
    postings = (tf.join(F.broadcast(stats.select("corpus_id", "avgdl")), "corpus_id")
                .join(idf.select("corpus_id", "token", "idf"), ["corpus_id", "token"])
                .select("corpus_id", "token", "doc_ord", "tf",
                        (F.col("dl") / F.col("avgdl")).alias("norm"), "idf"))
    return {"postings": postings, "idf": idf, "stats": stats.join(avg_idf, "corpus_id", "left"),
            "docs": ids}


def query_tokens(queries: DataFrame, keys: Sequence[str], text_col: str = "query",
                 analyzer: str = "word") -> DataFrame:
    """Query side: (keys..., [corpus_id,] token, qtf); duplicates counted."""
    pinned = ["corpus_id"] if "corpus_id" in queries.columns and "corpus_id" not in keys else []
    return (queries.select(*keys, *pinned, F.explode(tokenize(F.col(text_col), analyzer)).alias("token"))
            .groupBy(*keys, *pinned, "token").agg(F.count(F.lit(1)).alias("qtf")))


def score(queries: DataFrame, index: dict[str, DataFrame], keys: Sequence[str],
          text_col: str = "query", analyzer: str = "word", k1: float = K1, b: float = B) -> DataFrame:
    """BM25 score of every (query, doc) sharing a token; other docs score 0.

    A query row with a ``corpus_id`` is scored in that corpus only (the
    candidate tables of a question); without one it is scored in every
    corpus that shares a token with it, and no query x corpus pairs are
    formed.
    """
    qt = query_tokens(queries, keys, text_col, analyzer)
    on = ["corpus_id", "token"] if "corpus_id" in qt.columns else ["token"]
    p = index["postings"]
    contrib = (F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1)
               / (F.col("tf") + k1 * (1 - b + b * F.col("norm"))))
    return (qt.join(p, on)
            .groupBy(*keys, "corpus_id", "doc_ord").agg(F.sum(contrib).alias("score")))


def top_k(scores: DataFrame, keys: Sequence[str], k: int, score_col: str = "score",
          doc_col: str = "doc_ord") -> DataFrame:
    """Best k per query; ties -> later document first.

    Scores are compared at 1e-9 so that equal sums in a different order tie.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score_col, 9)), F.desc(doc_col))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: dict[str, DataFrame], keys: Sequence[str], k: int, text_col: str = "query",
           analyzer: str = "word", k1: float = K1, b: float = B, rare_docs: int = RARE_DOCS) -> DataFrame:
    """R3 R4 of queries with a ``corpus_id``: the rows of ``top_k(score(...))`` (keys..., corpus_id, doc_ord, score,
    rank), where queries that share tokens share their work.

    Queries of equal known tokens are one.  The documents that a rare token reaches
    are scored in full, at most ``rare_docs`` a token.  All other documents score by the frequent
    tokens alone, so each set of frequent tokens is scored once for all its queries: of a
    query with m documents by rare tokens, the k best others are among the k + m best of the set.
    """
    from ..sources.store import materialize
    keys = [c for c in keys if c != "corpus_id"]
    p, doc = index["postings"], ["_q", "corpus_id", "doc_ord"]
    contrib = (F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("norm"))))
    known = query_tokens(queries, keys, text_col, analyzer).join(index["idf"].select("corpus_id", "token", "df"), ["corpus_id", "token"])
    bags = materialize(known.groupBy(*keys, "corpus_id").agg(F.sort_array(F.collect_list(F.struct("token", "qtf", "df"))).alias("_bag")), "query-bags")
    asked = materialize(bags.select("corpus_id", "_bag").distinct().withColumn("_q", F.monotonically_increasing_id()), "query-asked")
    tokens = asked.select("_q", "corpus_id", F.inline("_bag"))
    rare, common = tokens.where(F.col("df") <= rare_docs), tokens.where(F.col("df") > rare_docs)

    near = materialize(rare.join(p, ["corpus_id", "token"]).groupBy(*doc).agg(F.sum(contrib).alias("score")), "query-near")
    more = (near.select(*doc).join(common, ["_q", "corpus_id"]).join(p, ["corpus_id", "token", "doc_ord"])
            .select(*doc, contrib.alias("score")))
    found = near.unionByName(more).groupBy(*doc).agg(F.sum("score").alias("score"))

    sets = (common.groupBy("_q", "corpus_id").agg(F.sort_array(F.collect_list(F.struct("token", "qtf"))).alias("_set"))
            .join(near.groupBy("_q").agg(F.count(F.lit(1)).alias("_m")), "_q", "left")
            .withColumn("_n", F.coalesce("_m", F.lit(0)) + k).drop("_m"))
    sets = materialize(sets, "query-sets")
    shared = materialize(sets.groupBy("corpus_id", "_set").agg(F.max("_n").alias("_most"))
                         .withColumn("_s", F.monotonically_increasing_id()), "query-shared")
    most = shared.agg(F.max("_most")).first()[0]
    if most is not None:
        scored = (shared.select("_s", "corpus_id", F.inline("_set")).join(p, ["corpus_id", "token"])
                  .groupBy("_s", "doc_ord").agg(F.sum(contrib).alias("score")))
        best = materialize(top_k(scored, ["_s"], most), "query-best")
        far = (sets.join(shared.drop("_most"), ["corpus_id", "_set"]).select("_q", "corpus_id", "_n", "_s")
               .join(best, "_s").where(F.col("rank") <= F.col("_n")).select(*doc, "score"))
        found = found.unionByName(far.join(near.select(*doc), doc, "left_anti"))
    top = top_k(found, ["_q"], k).drop("corpus_id")
    return bags.join(asked, ["corpus_id", "_bag"]).join(top, "_q").select(*keys, "corpus_id", "doc_ord", "score", "rank")


def top_k_padded(scores: DataFrame, queries: DataFrame, index: dict[str, DataFrame],
                 keys: Sequence[str], k: int) -> DataFrame:
    """R4 with padding: exactly min(k, N) docs per query.

    Documents that share no token score 0, between positive and negative
    scores, later documents first.  A query with m matched documents finds its
    k latest unmatched ones among the last k + m of the corpus, so those are
    looked up by their number from the end: no query x corpus product.
    """
    from .cells import group_ordinals
    keys = [c for c in keys if c != "corpus_id"]
    docs = index["docs"].select("corpus_id", "doc_ord").withColumn("_desc", -F.col("doc_ord"))
    from_end = group_ordinals(docs, ["corpus_id"], ["_desc"], col="_from_end").drop("_desc")
    matched = scores.groupBy(*keys, "corpus_id").agg(F.count(F.lit(1)).alias("_m"))
    need = queries.select(*keys, "corpus_id").distinct().join(matched, [*keys, "corpus_id"], "left")
    need = need.select(*keys, "corpus_id", F.explode(F.sequence(
        F.lit(0).cast("long"), F.coalesce("_m", F.lit(0)) + F.lit(k - 1))).alias("_from_end"))
    pad = (need.join(from_end, ["corpus_id", "_from_end"])
           .join(scores.select(*keys, "corpus_id", "doc_ord"), [*keys, "corpus_id", "doc_ord"], "left_anti")
           .select(*keys, "corpus_id", "doc_ord", F.lit(0.0).alias("score")))
    return top_k(scores.select(*keys, "corpus_id", "doc_ord", "score").unionByName(pad), [*keys, "corpus_id"], k)
