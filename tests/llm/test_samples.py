"""Bounded samples: thresholds by the odds of all labels, texts that count once."""

import random

import numpy as np
import pytest

from tabsleuth.llm import langid, toxicity
from tabsleuth.session import ship_package


class _Read:
    """A stand-in for the classifier: the text is the score."""

    prior_shift = 0.0

    def fit(self, docs, labels):
        return self

    def scores(self, docs):
        return np.array(docs, float)


@pytest.fixture
def read_scores(monkeypatch):
    monkeypatch.setattr(toxicity, "TextCNN", _Read)
    monkeypatch.setattr(toxicity, "word_ids", float)


def test_thresholds_keep_the_odds_of_all_labels(spark, read_scores):
    """Scores of clean documents reach to 0.8, those of toxic ones from 0.5 on.  With twenty clean to a toxic one the
    best cut is near 0.8, with as many of each it is near 0.5, whatever share of the clean ones is drawn."""
    rng = random.Random(3)
    rows = [(lang, toxic, rng.uniform(0.5, 1) if toxic else rng.uniform(0, 0.8))
            for lang, toxic, n in [("en", 1, 400), ("en", 0, 8000), ("de", 1, 400), ("de", 0, 400)] for _ in range(n)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, f"{s:.9f}", lang) for i, (lang, _, s) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, toxic int")
    whole = toxicity.learn(docs, labels, sample_rows=10000)
    assert whole.by_lang["en"] > 0.75 and whole.by_lang["de"] < 0.6 and whole.threshold > 0.75
    part = toxicity.learn(docs, labels, sample_rows=300)
    assert abs(part.threshold - whole.threshold) < 0.06
    assert {x: abs(part.by_lang[x] - t) < 0.06 for x, t in whole.by_lang.items()} == {"en": True, "de": True}


def test_weighted_threshold_is_that_of_repeated_rows():
    r = np.random.default_rng(5)
    s, y, w = r.random(200).round(2), r.integers(0, 2, 200), r.integers(1, 6, 200)
    assert toxicity.best_threshold(s, y, w) == toxicity.best_threshold(np.repeat(s, w), np.repeat(y, w))


@pytest.mark.parametrize("sample_rows", [60, 1000])
def test_language_sample_counts_copies_once(spark, sample_rows):
    """Thousands of copies of the text of smallest hash change nothing that is learned."""
    ship_package(spark)
    rng = random.Random(9)
    words = {"en": "the and of with that this from have water stone".split(), "de": "der und von mit dass dies vom haben wasser stein".split()}
    rows = [(" ".join(rng.choice(words[x]) for _ in range(12)), x) for x in words for _ in range(150)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    hot = docs.where("lang = 'en'").selectExpr("min_by(text, xxhash64(text)) t").first().t
    copies = spark.range(3000).selectExpr("'%s' text" % hot, "'en' lang")
    alone, among = (langid.learn(d, sample_rows) for d in (docs, docs.unionByName(copies)))
    assert alone.langs == among.langs == ["de", "en"] and alone.common == among.common
    assert alone.words.any() and np.array_equal(alone.words, among.words)
