"""License scan: phrases at their places, and an exact set-similarity join with license notices.

A block is a window of a text's words; windows of ``2 * stride`` words start at
every multiple of ``stride``, for each stride that a template asks for (the
least power of two that holds its words and a quarter more), so every run of
``stride`` + 1 words lies in a block.  A template is found in a block that
holds at least ``THRESHOLD`` of its distinct words.

The join is exact.  Words are ordered by their frequency in all documents,
rare ones first, ties by the word.  If a template and a block share at least
``need`` words, the first ``size - need + 1`` of either in that order have one
in common (prefix filter).  Blocks keep only words that some template has;
those with less than ``need`` of them are too short (length filter), and a
first common word so late that fewer than ``need`` could follow rules a
pair out (positional filter).  The pairs that are left are verified.  Texts stay
in their tasks: only the prefix words of a block that some template's prefix
has become rows.  The templates are an argument and bound what is broadcast.

Defined cases: a null text is empty: no words, no labels, score 0; rows equal
in id and text have equal results; a text of any length is scanned whole; a
tie of containment gives both labels; an empty table gives no rows; other
columns are ignored, whatever their names are.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, materialize
from .resample import words_of

THRESHOLD = 0.9

#: The phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening words of public license notices and their labels.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("lgpl", "This library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License "
             "as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("apache", "you may not use this file except in compliance with the License You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4 0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4 0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def least_common(size: int, threshold: float) -> int:
    """The least number of common words that reaches the threshold."""
    return max(1, math.ceil(size * threshold - 1e-9))


def stride_of(n_words: int) -> int:
    return 1 << max(2, math.ceil(math.log2(n_words * 1.25)))


def prepared(templates=None, threshold: float = THRESHOLD) -> pd.DataFrame:
    """label, template (its number), words (distinct), need, stride.  Templates without words go."""
    rows = []
    for k, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        words = words_of(text)
        if words:
            own = sorted({w.decode() for w in words})
            rows.append((label, k, own, least_common(len(own), threshold), stride_of(len(words))))
    return pd.DataFrame(rows, columns=["label", "template", "words", "need", "stride"])


def word_order(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """Rank of each template word by its occurrences in all documents, rare words first."""
    wanted = {w.encode() for w in vocabulary}

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                words = words_of(text)
                if not wanted.isdisjoint(words):
                    total.update(w for w in words if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])
    found = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(found["word"], found["n"]))
    return {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def _phrase_places(joined: bytes, phrases: dict[bytes, str]):
    """(label, word number) of each place of a phrase in words joined by single spaces."""
    for phrase, label in phrases.items():
        at, word, done = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", done, at)
            done = at
            yield label, word
            at = joined.find(phrase, at + 1)


def _blocks(at: np.ndarray, rank: np.ndarray, n_words: int, stride: int, openers: set[int]):
    """(start, ranks in ascending order) of the windows that hold a word of some template's prefix.
    ``at`` and ``rank`` are the places and ranks of the template words of a text."""
    starts = sorted({s for p, r in zip(at.tolist(), rank.tolist()) if r in openers
                     for s in (p // stride * stride, p // stride * stride - stride) if s >= 0})
    for s in starts:
        lo, hi = np.searchsorted(at, [s, min(n_words, s + 2 * stride)])
        yield s, np.unique(rank[lo:hi])


def _scan(docs: DataFrame, notices: pd.DataFrame, order: dict[str, int], phrases: dict[str, str]) -> DataFrame:
    """The written scan: doc_id, h1, h2, n_words, n_base, first_word, last_word, base (labels) and
    ``blocks``, the prefix words of blocks that some template may meet: stride, start, word (rank), place
    (in the prefix) and the ranks of all template words of the block."""
    by_bytes = {w.encode(): r for w, r in order.items()}
    found = {b" " + p.encode() + b" ": label for p, label in phrases.items()}
    plans = []         # for each stride: least words that a block needs, openers
    for stride, some in notices.groupby("stride"):
        openers = {r for words, need in zip(some["words"], some["need"]) for r in sorted(order[w] for w in words)[:len(words) - need + 1]}
        plans.append((int(stride), int(some["need"].min()), openers))
    every = set().union(*(p[2] for p in plans)) if plans else set()
    opening = {w for w, r in by_bytes.items() if r in every}
    block = pa.struct([("stride", pa.int32()), ("start", pa.int64()), ("word", pa.int32()), ("place", pa.int32()), ("ranks", pa.list_(pa.int32()))])

    def one(text):
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        places = list(_phrase_places(joined, found))
        blocks = []
        if not opening.isdisjoint(words):
            held = [(i, by_bytes[w]) for i, w in enumerate(words) if w in by_bytes]
            at, rank = np.array([i for i, _ in held], np.int64), np.array([r for _, r in held], np.int32)
            for stride, need, openers in plans:
                for start, ranks in _blocks(at, rank, len(words), stride, openers):
                    if len(ranks) >= need:
                        for place, r in enumerate(ranks[:len(ranks) - need + 1].tolist()):
                            if r in openers:
                                blocks.append({"stride": stride, "start": start, "word": r, "place": place, "ranks": ranks})
        at = [w for _, w in places]
        return (len(words), len(places), min(at, default=None), max(at, default=None), sorted({label for label, _ in places}), blocks)

    def run(batches):
        for b in batches:
            rows = [one(t) for t in b.column("text").to_pylist()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(block)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), *columns],
                                             names=["doc_id", "h1", "h2", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])
    key = doc_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["h1"].alias("h1"), key["h2"].alias("h2"), F.col("text").cast("string").alias("text"))
    return materialize(keyed.mapInArrow(
        run, "doc_id long, h1 long, h2 long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
             "blocks array<struct<stride: int, start: long, word: int, place: int, ranks: array<int>>>"), "license-scan")


def _join(scanned: DataFrame, notices: pd.DataFrame, order: dict[str, int]) -> DataFrame:
    """doc_id, h1, h2, start, n_words, template, label, containment of the pairs that reach the threshold."""
    spark = scanned.sparkSession
    prefixes = []
    for label, template, words, need, stride in notices.itertuples(index=False):
        ranks = sorted(order[w] for w in words)
        prefixes += [(int(stride), r, place, int(need), int(template), label, ranks) for place, r in enumerate(ranks[:len(ranks) - need + 1])]
    index = spark.createDataFrame(prefixes, "stride int, word int, t_place int, need int, template int, label string, t_ranks array<int>")
    blocks = (scanned.where(F.size("blocks") > 0)
              .select("doc_id", "h1", "h2", F.col("n_words").alias("doc_words"), F.explode("blocks").alias("b"))
              .select("doc_id", "h1", "h2", "doc_words", "b.stride", "b.start", "b.word", "b.place", "b.ranks"))
    left = F.least(F.size("ranks") - F.col("place"), F.size("t_ranks") - F.col("t_place"))       # with this word
    common = F.size(F.array_intersect("ranks", "t_ranks"))
    pairs = (blocks.join(F.broadcast(index), ["stride", "word"])
             .where((F.size("ranks") >= F.col("need")) & (F.col("place") <= F.size("ranks") - F.col("need"))
                    & (F.col("place") + F.col("t_place") + left >= F.col("need")))
             .withColumn("common", common).where("common >= need"))
    return pairs.select("doc_id", "h1", "h2", "start", F.least(F.lit(2) * F.col("stride"), F.col("doc_words") - F.col("start")).alias("n_words"),
                        "template", "label", (F.col("common") / F.size("t_ranks")).alias("containment")).dropDuplicates(
                            ["doc_id", "h1", "h2", "start", "n_words", "template"])


def _passes(docs, templates, threshold, phrases):
    notices = prepared(templates, threshold)
    order = word_order(docs, {w for words in notices["words"] for w in words}) if len(notices) else {}
    scanned = _scan(docs, notices, order, PHRASES if phrases is None else phrases)
    return scanned, _join(scanned, notices, order)


def notices(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, n_words (the block), template, label, containment: the blocks that meet a template."""
    return _passes(docs, templates, threshold, None)[1].drop("h1", "h2")


def label(docs: DataFrame, templates=None, threshold: float = THRESHOLD, phrases=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each document.
    The score is 1 where a phrase stands, else the highest containment of a notice, else 0."""
    scanned, met = _passes(docs, templates, threshold, phrases)
    best = met.groupBy("doc_id", "h1", "h2").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    best = best.select(F.col("doc_id").alias("b_id"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), "more", "best")
    out = scanned.drop("blocks").join(best, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
