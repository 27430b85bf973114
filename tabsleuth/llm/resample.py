"""Importance resampling towards a target distribution, with repeated lines computed once.

Texts are cut into lines at newlines.  The distinct lines of all documents are
found by one aggregation; the hashed n-gram counts of a line are computed once,
whatever the number of its occurrences, and multiplied by that number in the
corpus's bucket counts.  n-grams that cross a newline belong to no line; they
are counted for each document from the words at the edges of its lines and
added separately (with ``max_n`` = 1 there are none).  A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus; a line's
weight is the sum of the gains of its n-grams, and a document's the sum over
its lines and its crossings.  Gumbel noise from a hash of the id turns the
weights into draws without replacement: the highest scores are taken.

Documents meet the weights of their lines by a join on 128 bits of the line.
Lines that hold over 1 / ``HOT_LINES`` of all lines are fewer than ``HOT_LINES``;
these alone are broadcast, so the others' join has no hot key.  Ranks
come from a range sort and the counts of its partitions.

Defined cases: a null text has one empty line, so no n-grams, weight 0 and no
rank; equal scores are ordered by id, null ids last, then by text hash; rows equal
in id and text are ranked one after the other; texts of any length are read
whole; empty tables give no rows, an empty target uniform shares; other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, materialize, shuffle_parts
from .words import CACHE_WORDS

BUCKETS = 10_000
MAX_N = 1
SEED = "2024"
PERCENT = 10
MIN_WORDS = 20
HOT_LINES = 10_000

#: Words are runs of digits, letters and of anything beyond ASCII, on UTF-8 bytes; only A-Z are lower-cased.
WORD_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class _Buckets(dict):
    """Bucket of an n-gram, remembered up to a bounded number of them."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        b = self[gram] = zlib.crc32(gram) % self.buckets
        return b


def _grams(words: list[bytes], max_n: int) -> list[bytes]:
    out = list(words)
    for n in range(2, max_n + 1):
        out.extend(b" ".join(words[i:i + n]) for i in range(len(words) - n + 1))
    return out


def _crossing(text: str, max_n: int) -> list[bytes]:
    """The n-grams whose words do not all stand in one line.  Of a long line only the
    first and the last ``max_n - 1`` words can take part."""
    words: list[bytes] = []
    place: list[int] = []
    at = 0
    keep = max_n - 1
    for line in text.split("\n"):
        w = words_of(line)
        if len(w) > 2 * keep:
            edge = [*((x, at) for x in w[:keep]), (b"", at), *((x, at) for x in w[-keep:])]
        else:
            edge = [(x, at) for x in w]
        words.extend(x for x, _ in edge)
        place.extend(p for _, p in edge)
        at += 1
    return [b" ".join(words[i:i + n]) for n in range(2, max_n + 1) for i in range(len(words) - n + 1)
            if place[i] != place[i + n - 1] and b"" not in words[i:i + n]]


def _sparse(grams_of_rows, buckets: int):
    """Sparse bucket counts of each row as two list arrays, and the number of n-grams of each row."""
    find = _Buckets(buckets)

    def arrays(rows):
        lists = [grams_of_rows(r) for r in rows]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((find[g] for grams in lists for g in grams), np.int64, int(sizes.sum()))
        key = np.repeat(np.arange(len(lists)), sizes) * buckets + flat
        key, n = np.unique(key, return_counts=True)
        ends = np.searchsorted(key, np.arange(len(lists) + 1) * buckets).astype(np.int32)
        offsets = pa.array(ends, pa.int32())
        return (pa.ListArray.from_arrays(offsets, pa.array((key % buckets).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))), sizes)
    return arrays


def line_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, name: str = "resample-lines") -> DataFrame:
    """h1, h2, n, n_words, n_grams, buckets, counts: a row for each distinct line and its n occurrences."""
    lines = docs.select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.select(*_line_key(), "n", "line")

    def run(batches):
        count = _sparse(lambda words: _grams(words, max_n), buckets)
        for b in batches:
            words = [words_of(t) for t in b.column("line").to_pylist()]
            at, n, sizes = count(words)
            yield pa.RecordBatch.from_arrays(
                [b.column("h1"), b.column("h2"), b.column("n"), pa.array([len(w) for w in words], pa.int64()), pa.array(sizes), at, n],
                names=["h1", "h2", "n", "n_words", "n_grams", "buckets", "counts"])
    return materialize(lines.mapInArrow(run, "h1 long, h2 long, n long, n_words long, n_grams long, buckets array<int>, counts array<int>"), name)


def crossing_counts(docs: DataFrame, max_n: int, buckets: int = BUCKETS, name: str = "resample-crossings") -> DataFrame:
    """doc_id, h1, h2 (of the text), n_grams, buckets, counts: the n-grams of each row that cross a newline."""
    keyed = docs.select(*_doc_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches):
        count = _sparse(lambda text: _crossing(text, max_n), buckets)
        for b in batches:
            at, n, sizes = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), pa.array(sizes), at, n],
                                             names=["doc_id", "h1", "h2", "n_grams", "buckets", "counts"])
    return materialize(keyed.mapInArrow(run, "doc_id long, h1 long, h2 long, n_grams long, buckets array<int>, counts array<int>"), name)


def _line_key():
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("l"), F.col("line")).alias("h2")


def _doc_key():
    key = doc_key()
    return F.col("doc_id").cast("long").alias("doc_id"), key["h1"].alias("h1"), key["h2"].alias("h2")


def bucket_totals(parts: list[DataFrame], buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket over rows of (n, buckets, counts); ``buckets`` numbers come to the driver."""
    def add(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            lists = b.column("buckets")
            n = np.repeat(b.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()))
            np.add.at(total, lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy() * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    total = np.zeros(buckets, np.int64)
    for p in parts:
        summed = p.select("n", "buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
        total[summed["bucket"].to_numpy(np.int64)] += summed["n"].to_numpy(np.int64)
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the corpus)) of each bucket, shares smoothed by one."""
    size, big, small = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (big + size) / ((float(s) + 1) * (small + size))))
                     for s, t in zip(corpus, target)], np.int64)


def _weights(counted: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``weight``, the sum of the gains of the counted n-grams."""
    schema = ", ".join(f"{c} long" for c in [*keep, "weight"])

    def run(batches):
        for b in batches:
            lists = b.column("buckets")
            ends = lists.offsets.to_numpy()
            upto = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()] * b.column("counts").flatten().to_numpy())])
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(upto[ends[1:]] - upto[ends[:-1]])], names=[*keep, "weight"])
    return counted.select(*keep, "buckets", "counts").mapInArrow(run, schema)


def weigh(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, h1, h2, copies, n_words, n_features, weight: a row for each distinct (doc_id, text)."""
    lines = line_counts(docs, max_n, buckets)
    aims = line_counts(target, max_n, buckets, "resample-target")
    one = F.lit(1).cast("long").alias("n")
    corpus, wanted, crossing = [lines], [aims], None
    if max_n > 1:
        crossing = crossing_counts(docs, max_n, buckets)
        corpus.append(crossing.select(one, "buckets", "counts"))
        crossed = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
        wanted.append(crossing_counts(crossed, max_n, buckets, "resample-target-crossings").select(one, "buckets", "counts"))
    gain = gains(bucket_totals(corpus, buckets), bucket_totals(wanted, buckets))
    weights = materialize(_weights(lines, gain, ["h1", "h2", "n", "n_words", "n_grams"]), "resample-weights")
    value = F.struct("n_words", "n_grams", "weight")
    all_lines = weights.agg(F.sum("n")).first()[0] or 0
    hot = weights.where(F.col("n") > all_lines // HOT_LINES).select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), value.alias("hot"))
    rest = weights.select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), value.alias("rest")).where(F.col("n") <= all_lines // HOT_LINES)
    cut = docs.select(*_doc_key(), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("pos", "line"))
    places = cut.select("doc_id", "h1", "h2", (F.col("pos") == 0).cast("long").alias("first"),
                        F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("l"), F.col("line")).alias("l2"))
    places = materialize(places.join(F.broadcast(hot), ["l1", "l2"], "left"), "resample-places")
    own = ["doc_id", "h1", "h2", "first"]
    parts = (places.where("hot is not null").select(*own, F.col("hot").alias("v"))
             .unionByName(places.where("hot is null").join(rest, ["l1", "l2"]).select(*own, F.col("rest").alias("v")))
             .select(*own, "v.n_words", "v.n_grams", "v.weight"))
    if crossing is not None:
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(_weights(crossing, gain, ["doc_id", "h1", "h2", "n_grams"])
                                  .select("doc_id", "h1", "h2", zero.alias("first"), zero.alias("n_words"), "n_grams", "weight"))
    summed = parts.groupBy("doc_id", "h1", "h2").agg(*[F.sum(c).alias(c) for c in ("first", "n_words", "n_grams", "weight")])

    def each(c):
        return F.call_function("div", F.col(c), F.col("first"))
    return summed.select("doc_id", "h1", "h2", F.col("first").alias("copies"), each("n_words").alias("n_words"),
                         each("n_grams").alias("n_features"), each("weight").alias("weight"))


def _score(seed: str):
    """The weight and Gumbel noise in thousandths from the first 32 bits of a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: str = SEED,
         percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn), a row for each document."""
    spark = docs.sparkSession
    found = weigh(docs, target, max_n, buckets).withColumn("score", _score(seed))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("h1"), F.asc("h2")]
    placed = materialize(found.withColumn("able", F.col("n_words") >= min_words).repartitionByRange(shuffle_parts(spark), *order)
                         .withColumn("part", F.spark_partition_id()), "resample-sorted")
    sums = placed.where("able").groupBy("part").agg(F.sum("copies").alias("n"))
    offsets = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
                          F.call_function("div", F.sum("n").over(Window.partitionBy()) * percent, F.lit(100)).alias("places"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ranked = (placed.withColumn("upto", F.sum("copies").over(inside)).join(F.broadcast(offsets), "part", "left")
              .withColumn("nth", row).withColumn("place", F.col("before") + F.col("upto") - F.col("copies") + F.col("nth")))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score",
                         F.when(F.col("able") & (F.col("place") <= F.col("places")), F.col("place")).alias("rank"))
