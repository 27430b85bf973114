"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms (runs of letters, lower case) whose share of
documents lies between ``LOW`` and ``HIGH``: rarer terms are noise, commoner
ones say nothing.  Its size is at most the mean number of distinct terms of a
document over ``LOW``, however many documents there are, so it may be
broadcast.  A fingerprint hashes the sorted distinct lexicon terms of a text
once for each of ``len(RATES)`` random subsets of the lexicon; small subsets
survive edits, large ones tell texts apart.  The likeness of two fingerprints
is the share of equal hashes among the subsets that either text has terms of.

Defined cases: a null text is empty; a text without lexicon terms is hashed
as a whole, so only equal texts agree; equal texts have equal fingerprints;
null ids come last in descending order, ties are ordered by a hash of the
text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts
from .words import mix64, word_hashes

#: The band, as shares of the documents: inverse document frequencies of ln 2 to ln 1000.
LOW, HIGH = 0.001, 0.5
MIN_DF = 2
#: Share of the lexicon in each random subset.
RATES = tuple(2.0 ** -(1 + i % 9) for i in range(36))
TERM = re.compile(r"[^\W\d_]+")
EMPTY = "-" * 8
FLUSH = 400_000

_CUTS = np.array([int(r * 2 ** 64) for r in RATES], dtype=np.uint64)


def _count_terms(batches):
    """Document counts of the terms that a task has seen, at most ``FLUSH`` terms at a time."""
    seen: dict[str, int] = {}
    docs = 0

    def flush():
        words = list(seen)
        out = pd.DataFrame({"term": word_hashes(words).view(np.int64), "df": np.fromiter(seen.values(), np.int64, len(words))})
        seen.clear()
        return out
    for b in batches:
        docs += len(b)
        for text in b["text"]:
            if text:
                for w in set(TERM.findall(text.lower())):
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > FLUSH:
                yield flush()
    yield flush()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    terms = docs.select("text").mapInPandas(_count_terms, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = terms.where((F.col("df") >= max(MIN_DF, low * n)) & (F.col("df") <= max(MIN_DF, high * n))).select("term")
    return np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Subsets:
    """Which random subsets each term of a lexicon belongs to, found once for a task."""

    def __init__(self, lex: np.ndarray):
        self.lex = lex
        self.members = np.stack([mix64(lex, j + 1) < cut for j, cut in enumerate(_CUTS)])

    def fingerprint(self, text: str) -> str:
        h = np.unique(word_hashes(list(set(TERM.findall(text.lower())))))
        if len(self.lex) and len(h):
            at = np.searchsorted(self.lex, h)
            at[at == len(self.lex)] = 0
            known = self.lex[at] == h
            h, at = h[known], at[known]
        if not len(self.lex) or not len(h):
            raw = text.encode()
            return "".join(xxhash.xxh32_hexdigest(raw, seed=j) for j in range(len(RATES)))
        inside = self.members[:, at]
        some = inside.any(axis=1)
        return "".join([xxhash.xxh32_hexdigest(h[m].tobytes()) if any_ else EMPTY for m, any_ in zip(inside, some)])


def fingerprint(text: str, lex: np.ndarray) -> str:
    return Subsets(lex).fingerprint(text)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    same = filled = 0
    for i in range(0, len(a), 8):
        x, y = a[i:i + 8], b[i:i + 8]
        if x != EMPTY or y != EMPTY:
            filled += 1
            same += x == y
    return same / filled if filled else 0.0


def edited(text: str, other: str) -> str:
    """The last half of the text replaced by as much of the other's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _in_order(docs: DataFrame) -> DataFrame:
    """All documents in buckets of consecutive ids, and for each bucket the document that
    follows its last one in descending order (role 1).  The order is found from ids alone;
    each text is shuffled once."""
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2 ** 63))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce("text", F.lit("")).alias("text"))
    n = 8 * shuffle_parts(spark)
    cuts = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    # an id of many rows (null, above all) fills a bucket of its own, which is cut by the hash
    often = d.groupBy("id").count().where(F.col("count") > F.greatest(F.lit(2), F.lit(d.count() // n))).orderBy(F.desc("count")).limit(n).toPandas()["id"]
    often = np.sort(often.to_numpy(np.int64))
    bounds = np.unique(np.concatenate([bounds, often, often - (often > -(2 ** 63))]))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        i, h = ids.to_numpy(np.int64), hashes.to_numpy(np.int64)
        part = np.where(np.isin(i, often), (h >> 52) + 2048, 0)
        return pd.Series(np.searchsorted(bounds, i, side="left") * 4096 + part)

    d = d.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket("id", "h"))
    heads = d.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("head")).orderBy("bucket").collect()   # a row per bucket
    after = [(heads[i]["bucket"], heads[i - 1]["head"]["id"], heads[i - 1]["head"]["h"]) for i in range(len(heads))]
    after = spark.createDataFrame(after, "to long, a_id long, a_h long")
    follow = (d.join(F.broadcast(after), (F.col("id") == F.col("a_id")) & (F.col("h") == F.col("a_h")))
              .select("to", "id", "doc_id", "text", "h").dropDuplicates(["to"]))
    both = d.select("bucket", F.lit(0).alias("role"), "id", "doc_id", "text", "h").unionByName(
        follow.select(F.col("to").alias("bucket"), F.lit(1).alias("role"), "id", "doc_id", "text", "h"))
    return both.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket", "role", F.desc("id"), F.desc("h"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    lex = spark.sparkContext.broadcast(lexicon(docs))

    def run(batches):
        fingerprint = Subsets(lex.value).fingerprint
        held = None        # (bucket, doc_id, text, fingerprint) that waits for the next document
        for b in batches:
            rows = []
            for bucket, role, doc, text in b[["bucket", "role", "doc_id", "text"]].itertuples(index=False):
                own = fingerprint(text)
                if held is not None:
                    if held[0] != bucket:
                        raise RuntimeError(f"bucket {held[0]} does not end with the document that follows it")
                    new = edited(held[2], text)
                    new_print = fingerprint(new)
                    rows.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), held[3], new_print,
                                 likeness(held[3], new_print), likeness(held[3], own)))
                held = None if role else (bucket, doc, text, own)
            out = pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return _in_order(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                       "edited_fingerprint string, near_edited double, near_next double")
