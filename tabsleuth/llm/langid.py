"""Language identification with language-bitmask n-gram filters.

Learning: of a bounded sample of different labelled texts, character trigrams
(letters, lower case, runs of anything else as one blank) are counted per
language.  A trigram belongs to every language whose documents contain it at
least ``KEEP`` times as often as those of the language where it is commonest.
The filter is a bit-sliced Bloom filter: each slot is a word of language
bits, a trigram sets its languages' bits in ``HASHES`` slots, and the AND of
its slots returns all its languages in one look-up.  The slots are built in
Spark by a bitwise OR; their number is fixed, so the filter may be broadcast.

Deciding: per language, the trigram occurrences whose mask has its bit are
counted and corrected for the false positives that the language's fill
predicts; the highest corrected count wins, ties go to the first language.
The score is its share of all corrected counts.

Defined cases: a null text or one without letters is ``und`` with score 0;
without anything to learn from all texts are ``und``; a text that hits no
trigram gets the commonest learned language, score 0; null languages are not
learned; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_rows, held_out
from .words import mix64

#: Different texts learned from, of each language: the bound of the sample.
SAMPLE_ROWS = 3000
SLOT_BITS = 20
HASHES = 2
KEEP = 0.1
#: Documents of the sample that must hold a trigram.
MIN_DOCS = 3
#: A language of fewer texts than this for each of them asks for less.
TEXTS_PER_DOC = 20
CHUNK = 1 << 21
UNKNOWN = "und"

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def trigrams(texts: list[str]):
    """(trigram keys, index of the text each belongs to).

    All texts are handled as one array, each between two edges.  A run of
    other characters after a letter is one blank, as are the edges; a trigram
    has a letter in its middle, or a blank between two letters."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\x00" + "\x00\x00".join(lower) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    starts = 1 + np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + 2)[:-1]])
    edge = np.zeros(len(codes), bool)
    edge[starts - 1] = True
    edge[starts + sizes] = True
    letter = _letters()[codes]
    keep = letter | edge
    keep[1:] |= letter[:-1]
    at = np.flatnonzero(keep)
    v = np.where(letter[at], codes[at], 0).astype(np.uint64)
    middle = (v[1:-1] > 0) | ((v[:-2] > 0) & (v[2:] > 0) & ~edge[at[1:-1]])
    keys = (v[:-2] | v[1:-1] << np.uint64(21) | v[2:] << np.uint64(42))[middle]
    return keys, np.searchsorted(starts - 1, at[:-2][middle], side="right") - 1


def slots_of(keys: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    h = mix64(keys)
    return [(h >> np.uint64(i * 32)) & np.uint64((1 << slot_bits) - 1) for i in range(HASHES)]


def _count(batches):
    seen: dict[str, list] = {}
    for b in batches:
        for lang, rows in b.groupby("lang"):
            keys, doc = trigrams(rows["text"].tolist())
            # a document counts once for each of its trigrams
            pair = np.unique(np.stack([keys, doc.astype(np.uint64)], axis=1), axis=0) if len(keys) else np.zeros((0, 2), np.uint64)
            k, n = np.unique(pair[:, 0], return_counts=True)
            seen.setdefault(lang, []).append((k, n))
    for lang, parts in seen.items():
        k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(k))
        yield pd.DataFrame({"lang": lang, "gram": k.view(np.int64), "docs": n.astype(np.int64)})


class Filter:
    """``words[w][slot]`` has a bit for each of languages 64 w .. 64 w + 63."""

    def __init__(self, langs: list[str], words: np.ndarray, common: int):
        self.langs, self.words, self.common = langs, words, common
        self.slot_bits = int(words.shape[1]).bit_length() - 1
        fill = [np.count_nonzero(words[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / words.shape[1] for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES

    def counts(self, texts: list[str]):
        """(corrected counts by text and language, trigrams by text)."""
        keys, doc = trigrams(texts)
        n = np.bincount(doc, minlength=len(texts))
        slots = slots_of(keys, self.slot_bits)
        out = np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            if i % 64 == 0:
                hit = self.words[i // 64][slots[0]]
                for s in slots[1:]:
                    hit = hit & self.words[i // 64][s]
            bit = (hit >> np.uint64(i % 64)) & np.uint64(1)
            out[:, i] = np.bincount(doc, weights=bit, minlength=len(texts))
        false = np.minimum(self.false, 0.999)
        return np.maximum((out - n[:, None] * false) / (1 - false), 0.0), n

    def predict(self, texts: list[str | None]):
        langs, scores = [], []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size < CHUNK):
                size += len(texts[end] or "")
                end += 1
            some = [t or "" for t in texts[at:end]]
            counts, n = self.counts(some)
            total = counts.sum(axis=1)
            best = counts.argmax(axis=1) if self.langs else np.zeros(len(some), int)
            for i in range(len(some)):
                if not n[i] or not self.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                elif total[i] <= 0:
                    langs.append(self.langs[self.common])
                    scores.append(0.0)
                else:
                    langs.append(self.langs[best[i]])
                    scores.append(float(counts[i, best[i]] / total[i]))
            at = end
        return langs, scores


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slot_bits: int = SLOT_BITS) -> Filter:
    """``docs``: text and lang.  The sample of a language is its texts of smallest hash; copies of a text count once."""
    spark = docs.sparkSession
    d = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    d = d.withColumn("__h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("__h")
    with first_rows(spark, sample_rows):
        sample = (d.select("lang", "__h").dropDuplicates().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= sample_rows)
                  .groupBy("lang").agg(F.max("__h").alias("last"), F.count(F.lit(1)).alias("n")).collect())   # a row per language
    sizes = {r["lang"]: r["n"] for r in sample}
    langs = sorted(sizes)
    if not langs:
        return Filter([], np.zeros((1, 1 << slot_bits), np.uint64), 0)
    # A row per language tells which texts are in the sample; the other texts stay where they are.
    last = spark.createDataFrame([(r["lang"], r["last"]) for r in sample], "__lang string, __last long")
    d = (d.join(F.broadcast(last), (F.col("lang") == F.col("__lang")) & (F.col("__h") <= F.col("__last")))
         .dropDuplicates(["lang", "__h"]).select("text", "lang"))
    n_words = -(-len(langs) // 64)
    grams = d.mapInPandas(_count, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    info = spark.createDataFrame([(x, i, float(sizes[x])) for i, x in enumerate(langs)], "lang string, i int, n double")
    share = grams.join(F.broadcast(info), "lang").where(F.col("docs") >= F.least(F.lit(MIN_DOCS), 1 + F.floor(F.col("n") / TEXTS_PER_DOC)))
    # of few texts a share says less
    share = share.withColumn("share", F.col("docs") / (F.col("n") + 1))
    share = share.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= KEEP * F.col("top"))

    def slots(batches):
        for b in batches:
            for s in slots_of(b["gram"].to_numpy(np.int64).view(np.uint64), slot_bits):
                yield pd.DataFrame({"word": b["i"] // 64, "slot": s.astype(np.int64),
                                    "mask": (np.uint64(1) << (b["i"].to_numpy() % 64).astype(np.uint64)).view(np.int64)})

    found = share.select("gram", "i").mapInPandas(slots, "word int, slot long, mask long")
    found = found.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()    # at most a row per slot
    words = np.zeros((n_words, 1 << slot_bits), np.uint64)
    words[found["word"], found["slot"]] = found["mask"].to_numpy(np.int64).view(np.uint64)
    return Filter(langs, words, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i)))


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            langs, scores = shared.value.predict(b["text"].tolist())
            b = b.drop(columns="text")
            b["lang_pred"], b["score"] = langs, scores
            yield b
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
