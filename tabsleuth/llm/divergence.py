"""Divergence between the sources of a language, on a cube of (group block, group block, term block) cells.

A group is a (lang, source) pair.  Each language keeps the terms that stand in
at least ``MIN_DOCS`` of its documents; each group and each language gives each
kept term a smoothed integer share of ``UNIT``.  Two groups diverge by the sum
of the absolute differences of their shares.

The groups of a language are dealt into blocks of about ``GROUPS`` and its
kept terms into blocks of about ``TERMS``, both by hash.  A group's counts in
one term block are a slice.  Each slice is replicated to the cells of its
term block that its group block takes part in; a task owns whole cells, fills
a matrix of at most 2 x ``GROUPS`` by ``TERMS`` shares and emits the cell's part
of each divergence.  The parts are summed along the term axis.  A frequent
term or a large source is one number in the matrix, however many rows it has:
terms are counted inside the tasks before anything is shuffled.

All arithmetic is on integers.

Defined cases: null texts, languages and sources are read as ''; a group
without a kept term has smoothed shares only; a language without kept terms
has divergences of 0; equal values are ranked by the bytes of the item;
repeated rows count as often as they stand there; a text of any length is read
whole; an empty table gives no rows; other columns are ignored, whatever
their names are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_DOCS = 30
UNIT = 1_000_000_000
SMOOTH = 5
TERMS = 1024
GROUPS = 64
TOP_TERMS = 50
#: Rows up to which a table with a row for each language is broadcast.
LANGUAGES = 100_000
#: Distinct (group, term) pairs that a task holds before it passes them on.
FLUSH = 300_000

#: Terms are runs of letters and of anything beyond ASCII, on UTF-8 bytes; only A-Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _count_terms(batches):
    """Occurrences and documents of each (lang, source, term) that a task has seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, df) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(n)), pa.repeat(source, len(n)), pa.array([w.decode() for w in n], pa.string()),
                 pa.array(n.values(), pa.int64(), size=len(n)), pa.array((df[w] for w in n), pa.int64(), size=len(n))],
                names=["lang", "source", "term", "n", "df"])
        held.clear()
    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
            words = text.encode().translate(_TERM_BYTES).split()
            if not words:
                continue
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(words)
            df.update(set(words))
            size += len(n) - before
            if size >= FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def _share_column(n: Column, total: Column, vocabulary: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * vocabulary)), in decimals of 38 digits."""
    above = (n + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTH) * vocabulary).cast("decimal(19,0)")
    return F.call_function("div", above, below) + F.lit(1)


def _shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same on arrays: three digits of the quotient at a time, so that totals up to
    9 * 10**15 stay inside 64 bits."""
    rest = n + SMOOTH
    out = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def _cell(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The part of one term block in the divergences between two group blocks.

    Sources are ordered first, so a pair has the same direction in every term block."""
    lang, low, high, _ = key
    rows = rows.sort_values("source", kind="stable", ignore_index=True)
    n_terms = int(rows["n_terms"].iloc[0])
    names = rows["source"].to_numpy(object)
    blocks = rows["gblock"].to_numpy(np.int64)
    one, other = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    if n_terms:
        counts = np.zeros((len(rows), n_terms), np.int64)
        for k, (ids, ns) in enumerate(zip(rows["ids"], rows["ns"])):
            if ids is not None:
                counts[k, np.asarray(ids, np.int64)] = ns
        below = rows["total"].to_numpy(np.int64) + SMOOTH * rows["vocabulary"].to_numpy(np.int64)
        shares = _shares(counts, below[:, None])
    else:
        shares = np.zeros((len(rows), 1), np.int64)
    a, b, value = [], [], []
    for k, at in enumerate(one):
        against = other[k + 1:] if low == high else other
        if len(against):
            a.extend([names[at]] * len(against))
            b.extend(names[against])
            value.append(np.abs(shares[against] - shares[at]).sum(axis=1))
    out = pd.DataFrame({"lang": pd.Series([lang] * len(a), dtype=object), "a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})
    out["value"] = np.concatenate(value) if value else np.zeros(0, np.int64)
    return out


def _blocks(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")


def _beside(df: DataFrame) -> DataFrame:
    """A table with a row for each language, to be joined with rows of which one language may hold
    most: broadcast if it has at most ``LANGUAGES`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= LANGUAGES else df


def _block_of(name: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(name)), blocks.cast("long")).cast("int")


class Audit:
    """The written tables behind the reports: ``groups`` (lang, source, total, vocabulary, tblocks,
    gblocks, gblock), ``terms`` (lang, term, lang_n, block, id, n_terms) and ``counts``
    (lang, source, term, n, lang_n, block, id)."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, terms_per_block: int = TERMS, groups_per_block: int = GROUPS):
        d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counted = materialize(d.mapInArrow(_count_terms, "lang string, source string, term string, n long, df long")
                              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "audit-counts")
        kept = materialize(counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n"))
                           .where(F.col("df") >= min_docs).drop("df"), "audit-kept")
        sizes = _beside(materialize(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("lang_n").alias("lang_total")), "audit-sizes"))
        in_block = Window.partitionBy("lang", "block")
        self.terms = materialize(
            kept.join(sizes.select("lang", _blocks(F.col("vocabulary"), terms_per_block).alias("tblocks")), "lang")
            .withColumn("block", _block_of("term", F.col("tblocks")))
            .withColumn("id", F.row_number().over(in_block.orderBy("term")) - 1)
            .withColumn("n_terms", F.count(F.lit(1)).over(in_block)).drop("tblocks"), "audit-terms")
        self.counts = materialize(counted.drop("df").join(self.terms.drop("n_terms"), ["lang", "term"]), "audit-kept-counts")
        found = materialize(d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")), "audit-found")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        of_lang = _beside(materialize(found.groupBy("lang").agg(_blocks(F.count(F.lit(1)), groups_per_block).alias("gblocks")), "audit-langs"))
        zero = F.lit(0).cast("long")
        self.groups = materialize(
            found.join(totals, ["lang", "source"], "left").join(of_lang, "lang").join(sizes, "lang", "left")
            .select("lang", "source", "n_docs", F.coalesce("total", zero).alias("total"), F.coalesce("vocabulary", zero).alias("vocabulary"),
                    F.coalesce("lang_total", zero).alias("lang_total"), "gblocks")
            .withColumn("tblocks", _blocks(F.col("vocabulary"), terms_per_block))
            .withColumn("gblock", _block_of("source", F.col("gblocks"))), "audit-groups")

    def slices(self) -> DataFrame:
        """A row for each group and term block, also where the group has no term of the block."""
        own = (self.counts.groupBy("lang", "source", "block")
               .agg(F.collect_list(F.struct("id", "n")).alias("pairs"))
               .select("lang", "source", "block", F.col("pairs.id").alias("ids"), F.col("pairs.n").alias("ns")))
        sizes = self.terms.groupBy("lang", "block").agg(F.max("n_terms").alias("n_terms"))
        grid = self.groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("tblocks") - 1)))
        return (grid.join(own, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left")
                .withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("long"))))

    def divergences(self) -> DataFrame:
        """lang, source, item, value: both directions of every pair of a language's sources."""
        other = F.explode(F.sequence(F.lit(0), F.col("gblocks") - 1))
        cells = (self.slices().withColumn("__other", other)
                 .withColumn("low", F.least("gblock", "__other")).withColumn("high", F.greatest("gblock", "__other"))
                 .select("lang", "low", "high", "block", "source", "gblock", "total", "vocabulary", "n_terms", "ids", "ns"))
        parts = cells.groupBy("lang", "low", "high", "block").applyInPandas(_cell, "lang string, a string, b string, value long")
        whole = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
        return whole.select("lang", "value", F.explode(both).alias("p")).select("lang", "p.source", "p.item", "value")

    def excesses(self) -> DataFrame:
        """lang, source, item, value: kept terms of a group whose share exceeds that of its language."""
        of_group = self.groups.select("lang", "source", "total", "vocabulary", "lang_total")
        p = _share_column(F.col("n"), F.col("total"), F.col("vocabulary"))
        q = _share_column(F.col("lang_n"), F.col("lang_total"), F.col("vocabulary"))
        return (self.counts.join(of_group, ["lang", "source"])
                .select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0"))


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def report(docs: DataFrame, top_terms: int = TOP_TERMS, **options) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by divergence (``pair``) and the
    ``top_terms`` terms that a group uses most beyond its language (``term``)."""
    audit = Audit(docs, **options)
    return _ranked(audit.divergences(), "pair").unionByName(_ranked(audit.excesses(), "term").where(F.col("rank") <= top_terms))
