"""The toxicity classifier learns from every labelled text it may learn from."""

import random
import zlib

import numpy as np
import pytest

from tabsleuth.llm import toxicity
from tabsleuth.session import ship_package


@pytest.mark.parametrize("shard_rows", [1000, 10_000])
def test_every_labelled_text_is_learned_from(spark, monkeypatch, shard_rows):
    """Each text is a word of its own, so a text that was learned from has moved its word's embeddings."""
    ship_package(spark)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(7000)]
    docs = spark.createDataFrame([(i, w, "en") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(len(words))], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    fitted = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    moved = (model.net.table != toxicity.TextCNN().table).any(axis=1)
    assert np.mean([moved[toxicity.word_ids(w)[:2, 0]].all() for w in fitted]) > 0.97
    unseen = [w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 4 > 1]
    assert np.mean([moved[toxicity.word_ids(w)[:2, 0]].all() for w in unseen]) < 0.2


def test_thresholds_count_every_label(spark, monkeypatch):
    counted = []
    best = toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda s, y, w: counted.append((y * w).sum()) or best(s, y, w))
    ship_package(spark)
    docs = spark.range(12_000).selectExpr("id doc_id", "if(id % 4 = 0, 'bad ', 'good ') || 'text' text", "'en' lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) toxic")
    model = toxicity.learn(docs.union(docs.where("doc_id < 100")), labels)
    toxic = sum(zlib.crc32(str(i).encode()) % 4 == 3 for i in range(0, 12_000, 4))
    assert counted == [toxic, toxic]          # of the language, and of all; copies of a row are one
    assert model.net.scores([toxicity.word_ids("bad text")])[0] > model.threshold > model.net.scores([toxicity.word_ids("good text")])[0]
