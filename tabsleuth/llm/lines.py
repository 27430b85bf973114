"""Line dedup by a deletion-neighbourhood join.

Lines are compared as lower-case text without surrounding blanks.  Of equal
lines the earliest occurrence, by (document, line number), stays.  A line of
at least ``min_fuzzy`` characters also goes if an earlier line that long is within
one edit (a character inserted, deleted or replaced) of it; blank lines stay.

Two lines are within one edit if and only if deleting at most one character
from each makes them equal: equal lengths share a variant with the same
position deleted, and lengths that differ by one share the shorter line.
Variants are emitted as hashed keys and joined; a key's group needs no pairs,
as its earliest member decides for all others (those with the same position
deleted differ in that one character; the shorter line of a group is within
one edit of every longer one).  What a key proposes is verified on the texts.

A variant per character would be many times the text, so variants are emitted
only where they can meet: a pair within one edit agrees in one half, and then
in all but one block of ``BLOCK`` characters.  Both conditions are hashed
joins over all lines and drop no pair.  Texts travel only where a line of theirs
may have a partner, and once more where a line of theirs goes.

Defined cases: a null text has no lines and stays null; rows equal in id and
text are one document; an empty table gives no rows; other columns are kept
by `dedup`.  The earlier line counts even if it goes itself for another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, materialize, perhaps_among, surely_not_among

#: Default of ``min_fuzzy``: shorter lines only go as exact copies, as one edit is too much of them.
MIN_FUZZY = 20
BLOCK = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _normal(line):
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _exploded(docs: DataFrame) -> DataFrame:
    return docs.select("key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).select(
        "key", "line_no", _normal(F.col("line")).alias("line"))


def first_lines(docs: DataFrame, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """Distinct lines: h1, h2, n, first (document key and line number), half keys.

    ``docs`` has key and text.  A line of length n is keyed for partners of its
    own length and for partners that are one longer: by the first and the last
    half of the shorter length."""
    def halves(m):
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(m, F.lit("head"), F.left("line", half)), F.xxhash64(m, F.lit("tail"), F.right("line", half))]

    d = _exploded(docs).where("line <> ''").withColumn("n", F.length("line"))
    keys = F.when(F.col("n") >= min_fuzzy, F.array(*halves(F.col("n")), *halves(F.col("n") - 1)))
    return (d.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("b"), F.col("line")).alias("h2"), "n",
                     F.struct("key", "line_no").alias("at"), keys.alias("halves"))
            .groupBy("h1", "h2", "n").agg(F.min("at").alias("at"), F.any_value("halves").alias("halves")))


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows (k, h1, ...) whose k another line has too."""
    met = keyed.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("k")
    return keyed.join(materialize(met, "lines-met"), "k", "left_semi")


def _wanted_lines(batches):
    """The wanted lines of each text, as they stand."""
    for b in batches:
        rows = []
        for i, t1, t2, text, wanted in b[["id", "t1", "t2", "text", "wanted"]].itertuples(index=False):
            lines = text.split("\n")
            rows.extend((i, t1, t2, w["line_no"], w["h1"], lines[w["line_no"]]) for w in wanted)
        yield pd.DataFrame(rows, columns=["id", "t1", "t2", "line_no", "h1", "line"])


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            for name, b in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size + 1, np.uint64(b))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def _mixed(*parts) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint64(0)
        for p in parts:
            x = (x ^ np.asarray(p, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(31))
        return (x * np.uint64(0x94D049BB133111EB)).view(np.int64)


class _Hashed:
    """Polynomial prefix hashes of a line: any part's hash in constant time."""

    def __init__(self, line: str):
        c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        up, self.down = _POWERS.upto(self.n + 1)
        self.head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up[:self.n], dtype=np.uint64)])

    def tail(self, at):
        """Hash of the part from ``at`` on, as if it began at 0."""
        return (self.head[self.n] - self.head[at]) * self.down[at]


def _block_keys(h: _Hashed, m: int):
    """For partners whose shorter length is m: block numbers and keys of the line without that block."""
    i = np.arange(-(-m // BLOCK))
    tail = m - np.minimum(m, (i + 1) * BLOCK)
    return i, _mixed(np.full(len(i), m), i, h.head[i * BLOCK], h.tail(h.n - tail))


def _emit_blocks(batches):
    for b in batches:
        for at in range(0, len(b), 20_000):
            k, h1, ms, blocks = [], [], [], []
            for x, line in b[["h1", "line"]].iloc[at:at + 20_000].itertuples(index=False):
                h = _Hashed(line)
                for m in (h.n, h.n - 1):
                    i, keys = _block_keys(h, m)
                    k.append(keys)
                    blocks.append(i)
                    ms.append(np.full(len(i), m))
                    h1.append(np.full(len(i), x))
            if k:
                yield pd.DataFrame({"k": np.concatenate(k), "h1": np.concatenate(h1), "m": np.concatenate(ms), "block": np.concatenate(blocks)})


def _emit_variants(batches):
    """Variants of a line where its blocks meet another's: role s has a position deleted for partners of
    equal length, role 1 has a character deleted, role 0 is the line itself."""
    for b in batches:
        k, h1, role = [], [], []

        def put(keys, x, r):
            k.append(keys)
            h1.append(np.full(len(keys), x))
            role.append(np.full(len(keys), r))
        for x, line, met in b[["h1", "line", "met"]].itertuples(index=False):
            h = _Hashed(line)
            put(_mixed(np.array([1]), np.array([h.n]), h.head[h.n:]), x, 0)
            for m, block in {(int(y["m"]), int(y["block"])) for y in met}:
                longer = int(m < h.n)
                p = np.arange(block * BLOCK, min(h.n, (block + 1) * BLOCK + longer))
                if longer:
                    whole = h.head[p] + h.down[1] * (h.head[h.n] - h.head[p + 1])
                    put(np.unique(_mixed(np.ones(len(p), np.int64), np.full(len(p), m), whole)), x, 1)
                else:
                    put(_mixed(np.full(len(p), 2), p, np.full(len(p), h.n), h.head[p], h.tail(p + 1)), x, 2)
        if k:
            yield pd.DataFrame({"k": np.concatenate(k), "h1": np.concatenate(h1), "role": np.concatenate(role)})


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``at`` of the lines that an earlier line is within one edit of."""
    keyed = firsts.where("halves is not null").select("h1", F.explode("halves").alias("k"))
    some = materialize(_shared(keyed).select("h1").distinct(), "lines-halves")
    wanted = (firsts.select("h1", "at").join(some, "h1", "left_semi")
              .groupBy("at.key").agg(F.collect_list(F.struct("at.line_no", "h1")).alias("wanted")))
    wanted = materialize(wanted, "lines-wanted")
    found = perhaps_among(docs, "key", wanted, "key").join(wanted, "key")
    texts = (found.select("key.id", F.col("key.h1").alias("t1"), F.col("key.h2").alias("t2"), "text", "wanted")
             .mapInPandas(_wanted_lines, "id long, t1 long, t2 long, line_no int, h1 long, line string"))
    key = F.struct("id", F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    texts = texts.select(_normal(F.col("line")).alias("line"), "h1", F.struct(key.alias("key"), "line_no").alias("at"))
    texts = materialize(texts.dropDuplicates(["at"]), "lines-texts")
    blocks = materialize(texts.mapInPandas(_emit_blocks, "k long, h1 long, m int, block int"), "lines-blocks")
    met = _shared(blocks).groupBy("h1").agg(F.collect_set(F.struct("m", "block")).alias("met"))
    met = texts.join(materialize(met, "lines-edges"), "h1")
    variants = met.select("h1", "line", "met").mapInPandas(_emit_variants, "k long, h1 long, role int")
    order = texts.select("h1", F.struct("at", "h1").alias("who"))
    variants = materialize(variants.join(order, "h1").select("k", "role", "who"), "lines-variants")

    def earliest(r):
        return F.min(F.when(F.col("role") == r, F.col("who")))
    groups = (variants.groupBy("k").agg(earliest(0).alias("w0"), earliest(1).alias("w1"), earliest(2).alias("w2"),
                                        F.max("who").alias("last"))
              .where("(w0 is not null and w1 is not null) or w2 <> last"))
    found = variants.join(materialize(groups, "lines-groups"), "k")
    other = F.when(F.col("role") == 0, F.col("w1")).when(F.col("role") == 1, F.col("w0")).otherwise(F.col("w2"))
    pairs = found.select("who", other.alias("earlier")).where("earlier < who").distinct()
    pairs = materialize(pairs, "lines-pairs")
    a = texts.select(F.col("at").alias("a_at"), F.col("line").alias("a_line"))
    b = texts.select(F.col("at").alias("b_at"), F.col("line").alias("b_line"))
    pairs = pairs.join(a, F.col("who.at") == F.col("a_at")).join(b, F.col("earlier.at") == F.col("b_at"))
    return pairs.where(F.levenshtein("a_line", "b_line", 1) >= 0).select("who.at").distinct()


def _keep(batches):
    for b in batches:
        texts, lines, removed = [], [], []
        for text, kept in b[["text", "__kept"]].itertuples(index=False):
            if text is None:
                texts.append(None)
                lines.append(0)
                removed.append(0)
                continue
            all_lines = text.split("\n")
            kept = set() if kept is None else set(kept)
            stay = [x for i, x in enumerate(all_lines) if i in kept or not x.strip(" \t\r")]
            texts.append("\n".join(stay))
            lines.append(len(all_lines))
            removed.append(len(all_lines) - len(stay))
        b = b.drop(columns="__kept")
        b["text"], b["__lines"], b["__removed"] = texts, lines, removed
        yield b


def dedup(docs: DataFrame, min_fuzzy: int = MIN_FUZZY) -> DataFrame:
    """``docs`` with the lines that stay as text, and ``__lines`` and ``__removed``, their numbers.

    Only documents that lose a line meet the numbers of the lines that they keep; the others stay in place."""
    d = docs.select(doc_key().alias("key"), "text")
    firsts = materialize(first_lines(d, min_fuzzy), "lines-first")
    near = materialize(near_lines(d, firsts), "lines-near")
    kept = (firsts.select("at").join(near, "at", "left_anti")
            .groupBy(F.col("at.key").alias("__k")).agg(F.collect_list("at.line_no").alias("__kept")))
    kept = materialize(kept, "lines-kept")
    lines = F.split("text", "\n", -1)
    filled = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    counted = d.where("text is not null").select("key", filled.alias("filled"))
    stay = kept.select("__k", F.size("__kept").alias("stay"))
    losing = (counted.join(stay, F.col("key") == F.col("__k"), "left")
              .where(F.col("filled") > F.coalesce("stay", F.lit(0))).select("key").distinct())
    losing = materialize(losing, "lines-losing")
    keyed = docs.withColumn("__key", doc_key())
    out = perhaps_among(keyed, "__key", losing, "key").join(kept, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    changed = out.mapInPandas(_keep, types + ", __lines long, __removed long")
    whole = surely_not_among(keyed, "__key", losing, "key").drop("__key")
    number = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return whole.withColumn("__lines", number).withColumn("__removed", F.lit(0).cast("long")).unionByName(changed)
