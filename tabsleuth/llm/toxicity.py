"""Toxicity scores from a convolutional text classifier in numpy.

A word (a run of letters, lower case) and its first letters are each hashed
twice into one table of embeddings, and the word is the sum of these rows: two
words rarely share both rows of a hash, and unseen forms of a stem still share
the stem's.  Filters of several widths slide over the words of the whole text; the
largest response of each filter, cut at zero, feeds a logistic unit.  The
model is trained on all labelled documents by Adagrad; through
the max pooling only the best window of each filter carries a gradient.

The labelled documents are dealt by hash into shards of about `SHARD_ROWS`.  In each
round every shard is one task: it takes the shared model a pass further
over its own texts, and the places it changed (rows of the embeddings, filters, squared
gradients) are averaged over the shards that changed them.  Only the model, of
fixed size, reaches the driver.  A single shard is trained in one go.

Thresholds are calibrated by language on labelled documents that the training
did not see, all of them, scored in tasks and counted by score (to four digits):
the threshold of best F1 of a language with enough toxic ones,
else that of all together.  The language chooses the
threshold only; it is never an input of the score.

A caller may bound the texts with ``sample_rows``: the model is then trained on the driver and
a row of the calibration sample weighs as many labelled rows of its label (and
language) as it stands for.

Defined cases: a null or empty text has no words and gets the score that the
bias gives; without labels of both kinds every score is the share of toxic
labels (0 if none); several labels of an id count as toxic if one is; null
labels are ignored; repeated rows are scored one by one; other columns are
kept by `score`.
"""

from __future__ import annotations

import copy
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_rows, held_out, materialize, perhaps_among
from .words import mix64, word_hashes

#: Labelled documents of a shard, about.
SHARD_ROWS = 4096
#: Passes over all labelled documents where there are several shards.
ROUNDS = 3
#: Embeddings that are averaged together.
BLOCK_ROWS = 256
#: Of the remainders of crc32 mod 4 that may be learned from, the one kept for the thresholds.
CALIBRATION = 3
BUCKET_BITS = 16
STEM = 4
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
RATE = 0.15
MIN_TOXIC = 20
DEFAULT_THRESHOLD = 0.3
CHUNK_WORDS = 1 << 17
WORD = re.compile(r"[^\W\d_]+")

HASHED = 4


def word_ids(text: str | None) -> np.ndarray:
    """Buckets of each word, HASHED x n: two of the word, two of its stem; bucket 0 is kept for padding."""
    words = WORD.findall(text.lower()) if text else []
    word, stem = word_hashes(words), word_hashes([w[:STEM] for w in words])
    cut = np.uint64(64 - BUCKET_BITS)
    rows = [mix64(word, 1) >> cut, mix64(word, 2) >> cut, mix64(stem, 3) >> cut, mix64(stem, 4) >> cut]
    return np.maximum(np.stack(rows).astype(np.int32), 1)


class TextCNN:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (1 << BUCKET_BITS, DIM)).astype(np.float32)
        self.table[0] = 0
        # One column for each filter and place in its window.
        self.kernels = {w: r.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = r.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.offset = np.float32(0)
        self.prior_shift = 0.0
        self.grown: dict[str, np.ndarray] | None = None

    def _dense(self) -> dict[str, np.ndarray]:
        return {**{f"kernel{w}": k for w, k in self.kernels.items()}, "bias": self.bias, "out": self.out}

    def _start(self) -> dict[str, np.ndarray]:
        """Sums of squared gradients: those of earlier passes, else new ones."""
        if self.grown is None:
            self.grown = {n: np.full(p.shape, 1e-6, np.float32) for n, p in {"table": self.table, **self._dense()}.items()}
            self.grown["offset"] = 1e-6
        return self.grown

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights but the embeddings, and their sums of squared gradients, as vectors."""
        g, dense = self._start(), self._dense()
        return (np.concatenate([*[p.ravel() for p in dense.values()], [self.offset]]).astype(np.float64),
                np.concatenate([*[g[n].ravel() for n in dense], [g["offset"]]]).astype(np.float64))

    def unpack(self, weights: np.ndarray, grown: np.ndarray) -> None:
        g, at = self._start(), 0
        for n, p in self._dense().items():
            p[...] = weights[at:at + p.size].reshape(p.shape)
            g[n][...] = grown[at:at + p.size].reshape(p.shape)
            at += p.size
        self.offset, g["offset"] = np.float32(weights[-1]), float(grown[-1])

    def _responses(self, x: np.ndarray):
        """Filter responses at every word; x ends with padding."""
        for i, w in enumerate(WIDTHS):
            n = len(x) - max(WIDTHS) + 1
            y = x[:n] @ self.kernels[w][0]
            for j in range(1, w):
                y += x[j:n + j] @ self.kernels[w][j]
            yield i, y

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each text is followed by padding, so no window joins two texts."""
        out = np.empty(len(docs), np.float32)
        pad = np.zeros((HASHED, max(WIDTHS) - 1), np.int32)
        some = [d if d.shape[1] else np.zeros((HASHED, 1), np.int32) for d in docs]
        at = 0
        while at < len(some):
            n, end = 0, at
            while end < len(some) and (end == at or n + some[end].shape[1] <= CHUNK_WORDS):
                n += some[end].shape[1]
                end += 1
            out[at:end] = self._logits([y for d in some[at:end] for y in (d, pad)])
            at = end
        return out + np.float32(self.prior_shift)

    def _logits(self, parts: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([p.shape[1] for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::2]
        z = np.full(len(starts), self.offset, np.float32)
        longest, step = int(sizes.max()), 1 << 18
        if longest > step:             # one very long text: windows in blocks, the maximum over all
            ids = np.concatenate(parts, axis=1)
            best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
            for a in range(0, ids.shape[1] - max(WIDTHS) + 1, step):
                x = self._embed(ids[:, a:a + step + max(WIDTHS) - 1])
                for i, y in self._responses(x):
                    best[i] = np.maximum(best[i], y.max(axis=0))
            return z + np.float32((np.maximum(best + self.bias, 0) * self.out).sum())
        x = self._embed(np.concatenate(parts, axis=1))
        for i, y in self._responses(x):
            top = np.maximum.reduceat(y, starts, axis=0)
            z += np.maximum(top + self.bias[i], 0) @ self.out[i]
        return z

    def _embed(self, ids: np.ndarray) -> np.ndarray:
        x = self.table[ids[0]]
        for row in ids[1:]:
            x += self.table[row]
        return x

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(docs).astype(np.float64)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> TextCNN:
        r = np.random.default_rng(seed)
        pad = np.zeros((HASHED, max(WIDTHS) - 1), np.int32)
        some = [d if d.shape[1] else np.zeros((HASHED, 1), np.int32) for d in docs]
        grown = self._start()

        def step(name, p, where, g):
            a = grown[name]
            a[where] += g * g
            p[where] -= RATE * g / np.sqrt(a[where])

        for _ in range(epochs):
            order = r.permutation(len(some))
            for at in range(0, len(order), BATCH):
                batch = order[at:at + BATCH]
                ids = np.concatenate([y for i in batch for y in (some[i], pad)], axis=1)      # padded here: no second copy of all texts
                x = self._embed(ids)
                ends = np.cumsum([some[i].shape[1] + pad.shape[1] for i in batch])
                starts = np.concatenate([[0], ends[:-1]])
                z, best, top = np.full(len(batch), self.offset, np.float32), [], []
                for i, y in self._responses(x):
                    where = np.stack([s + y[s:e - max(WIDTHS) + 1].argmax(axis=0) for s, e in zip(starts, ends)])
                    best.append(where)
                    top.append(np.maximum(np.take_along_axis(y, where, axis=0) + self.bias[i], 0))
                    z += top[i] @ self.out[i]
                d = ((1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)).astype(np.float32)
                rows, grads = [], []
                new_kernels = {}
                for i, w in enumerate(WIDTHS):
                    through = d[:, None] * self.out[i] * (top[i] > 0)              # batch x filters
                    step("bias", self.bias, i, through.sum(axis=0))
                    step("out", self.out, i, d @ top[i])
                    k = np.empty_like(self.kernels[w])
                    for j in range(w):
                        at_words = best[i] + j
                        k[j] = np.einsum("bf,bfd->df", through, x[at_words])
                        rows.append(ids[:, at_words].reshape(HASHED, -1))
                        grads.append((through[:, :, None] * self.kernels[w][j].T[None]).reshape(-1, DIM))
                    new_kernels[w] = k
                for w, k in new_kernels.items():
                    step(f"kernel{w}", self.kernels[w], slice(None), k)
                rows, grads = np.concatenate(rows, axis=1), np.concatenate(grads)
                used, inverse = np.unique(rows.reshape(-1), return_inverse=True)
                g = np.zeros((len(used), DIM), np.float32)
                np.add.at(g, inverse, np.concatenate([grads] * HASHED))
                g[used == 0] = 0
                step("table", self.table, used, g)
                s = float(d.sum())
                grown["offset"] += s * s
                self.offset -= np.float32(RATE * s / grown["offset"] ** 0.5)
        return self


class Constant:
    """The model where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, docs) -> np.ndarray:
        return np.full(len(docs), self.share)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Of best F1 of the weighted rows, in the middle between two scores."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    w = np.ones(len(y)) if weights is None else weights[order]
    hit = np.cumsum(y * w)
    f1 = 2 * hit / (np.cumsum(w) + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1          # equal scores cannot be told apart
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


class Model:
    def __init__(self, net, threshold: float, by_lang: dict[str, float]):
        self.net, self.threshold, self.by_lang = net, threshold, by_lang


def _weights(labels: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Of each drawn row the share of all ``counts`` rows of its label that it stands for."""
    return np.where(labels > 0, counts[1] / max(labels.sum(), 1), counts[0] / max((labels == 0).sum(), 1))


def _learnable(docs: DataFrame, labels: DataFrame):
    """Labels by id (toxic if one is), rows that may be learned from, and whether a row is for the thresholds."""
    y = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id"))
         .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    d = docs.where(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    return y, d, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == CALIBRATION


def _labelled(docs: DataFrame, labels: DataFrame, sample_rows: int):
    """(text, lang, toxic, calibrate) of each label and part the rows of smallest hash,
    and the number of all by label, part and language."""
    y, d, part = _learnable(docs, labels)
    ids = (d.select("doc_id", "lang", F.xxhash64("text").alias("h")).join(y, F.col("doc_id") == F.col("__id"))
           .withColumn("calibrate", part))
    counts = ids.groupBy("toxic", "calibrate", "lang").count().collect()    # at most four rows a language
    # copies of one row are one row of the sample, on either side of the join
    ids = ids.select("__id", "h", "toxic", "calibrate").distinct()
    first = Window.partitionBy("toxic", "calibrate").orderBy("h", "__id")
    ids = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_rows).drop("n")
    with first_rows(docs.sparkSession, sample_rows):
        chosen = d.join(F.broadcast(ids), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["doc_id", "h"])
        rows = chosen.select("doc_id", "text", "lang", "toxic", "calibrate").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return rows, counts


def _learn_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Model:
    """Train and calibrate on the driver, on at most four times ``sample_rows`` texts."""
    rows, counts = _labelled(docs, labels, sample_rows)
    ids = [word_ids(t) for t in rows.pop("text")]
    y = rows["toxic"].to_numpy(np.float32)
    cal = rows["calibrate"].to_numpy(bool)
    fit = np.flatnonzero(~cal)
    if len(fit) == 0 or y[fit].min() == y[fit].max():
        return Model(Constant(float(y.mean()) if len(y) else 0.0), DEFAULT_THRESHOLD, {})
    net = TextCNN().fit([ids[i] for i in fit], y[fit])
    drawn = y[fit].sum()
    all_rows = {k: sum(r["count"] for r in counts if r["toxic"] == k) for k in (0, 1)}
    net.prior_shift = float(np.log(all_rows[1] / all_rows[0]) - np.log(drawn / (len(fit) - drawn)))
    found = np.flatnonzero(cal)
    if len(found) == 0 or y[found].sum() < MIN_TOXIC or y[found].min() == y[found].max():
        return Model(net, DEFAULT_THRESHOLD, {})
    s, langs, y = net.scores([ids[i] for i in found]), rows["lang"].to_numpy()[found], y[found]
    part = [r for r in counts if r["calibrate"]]
    by_lang = {}
    for lang in {x for x in langs if x is not None}:
        own = langs == lang
        if y[own].sum() >= MIN_TOXIC and y[own].min() == 0:
            of_lang = {r["toxic"]: r["count"] for r in part if r["lang"] == lang}
            by_lang[lang] = best_threshold(s[own], y[own], _weights(y[own], of_lang))
    of_part = {k: sum(r["count"] for r in part if r["toxic"] == k) for k in (0, 1)}
    return Model(net, best_threshold(s, y, _weights(y, of_part)), by_lang)


_PARTS = "block int, places binary, weights binary, grown binary"


def _train_shard(shared, epochs: int):
    """A group of rows takes the shared model ``epochs`` further: what it changed, by block of embeddings;
    block -1 is the rest of the model."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        y = pdf["toxic"].to_numpy(np.float32)
        net = copy.deepcopy(shared.value)
        w0, g0 = net.pack()
        table, grown = shared.value.table, shared.value.grown["table"]
        net.fit([word_ids(t) for t in pdf["text"]], y, epochs)
        w, g = net.pack()
        rows = [(-1, b"", (w - w0).tobytes(), (g - g0).tobytes())]
        used = np.flatnonzero((net.grown["table"] != grown).any(axis=1))
        for block in np.split(used, np.flatnonzero(np.diff(used // BLOCK_ROWS)) + 1):
            if len(block):
                rows.append((int(block[0]) // BLOCK_ROWS, block.astype(np.int32).tobytes(), (net.table[block] - table[block]).tobytes(),
                             (net.grown["table"][block] - grown[block]).tobytes()))
        return pd.DataFrame(rows, columns=["block", "places", "weights", "grown"])
    return run


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean change of each place of a block over the shards that changed it."""
    block = int(pdf["block"].iloc[0])
    # in an order of their own, as sums depend on it
    pdf = pdf.sort_values(["places", "weights", "grown"], kind="stable")
    if block < 0:
        w, g = (np.mean([np.frombuffer(x) for x in pdf[c]], axis=0) for c in ("weights", "grown"))
        return pd.DataFrame({"block": [block], "places": [b""], "weights": [w.tobytes()], "grown": [g.tobytes()]})
    at = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["places"]])
    places, inverse, n = np.unique(at, return_inverse=True, return_counts=True)
    sums = []
    for c in ("weights", "grown"):
        total = np.zeros((len(places), DIM))
        np.add.at(total, inverse, np.concatenate([np.frombuffer(x, np.float32) for x in pdf[c]]).reshape(-1, DIM))
        sums.append((total / n[:, None]).astype(np.float32).tobytes())
    return pd.DataFrame({"block": [block], "places": [places.astype(np.int32).tobytes()], "weights": [sums[0]], "grown": [sums[1]]})


def _train(rows: DataFrame, n: int) -> TextCNN:
    """The model of all ``n`` rows (doc_id, h, text, toxic), passes over shards in tasks."""
    sc, net = rows.sparkSession.sparkContext, TextCNN()
    shards = -(-n // SHARD_ROWS)
    rounds, epochs = (1, EPOCHS) if shards == 1 else (ROUNDS, 1)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("h", "doc_id"), F.lit(shards)))
    for _ in range(rounds):
        net._start()
        shared = sc.broadcast(net)
        parts = dealt.groupBy("shard").applyInPandas(_train_shard(shared, epochs), _PARTS)
        # written first: the sizes of its files say nothing of the work behind them
        changes = materialize(parts, "toxicity-parts").groupBy("block").applyInPandas(_average, _PARTS).toPandas()
        net = copy.deepcopy(net)
        w, g = net.pack()
        for block, places, dw, dg in changes[["block", "places", "weights", "grown"]].itertuples(index=False):
            if block < 0:
                net.unpack(w + np.frombuffer(dw), g + np.frombuffer(dg))
            else:
                at = np.frombuffer(places, np.int32)
                net.table[at] += np.frombuffer(dw, np.float32).reshape(-1, DIM)
                net.grown["table"][at] += np.frombuffer(dg, np.float32).reshape(-1, DIM)
        shared.destroy()
    net.grown = None               # scoring has no use for it
    return net


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int | None = None) -> Model:
    """Train and calibrate on all labelled texts, in tasks; with ``sample_rows`` on a bounded sample of them."""
    if sample_rows is not None:
        return _learn_sample(docs, labels, sample_rows)
    y, d, part = _learnable(docs, labels)
    # texts without a label stay where they are
    rows = (perhaps_among(d, "doc_id", y, "__id").join(y, F.col("doc_id") == F.col("__id"))
            .select("doc_id", F.xxhash64("text").alias("h"), "text", "lang", "toxic", part.alias("calibrate")).dropDuplicates(["doc_id", "h"]))
    rows = materialize(rows, "toxicity-labelled")
    counts = {(r["calibrate"], r["toxic"]): r["count"] for r in rows.groupBy("calibrate", "toxic").count().collect()}
    fit = [counts.get((False, k), 0) for k in (0, 1)]
    if not min(fit):
        n = sum(counts.values())
        return Model(Constant(sum(c for (_, k), c in counts.items() if k) / n if n else 0.0), DEFAULT_THRESHOLD, {})
    net = _train(rows.where("not calibrate").select("doc_id", "h", "text", "toxic"), sum(fit))
    if min(counts.get((True, 0), 0), counts.get((True, 1), 0) // MIN_TOXIC) == 0:
        return Model(net, DEFAULT_THRESHOLD, {})
    scored = score(rows.where("calibrate").select("text", "lang", "toxic"), Model(net, DEFAULT_THRESHOLD, {}))
    # at most 10,001 scores of each label and language
    found = scored.groupBy("lang", "toxic", F.round("__score", 4).alias("s")).count().toPandas()

    def best(of):
        of = of.groupby(["s", "toxic"], as_index=False)["count"].sum()
        return best_threshold(of["s"].to_numpy(float), of["toxic"].to_numpy(float), of["count"].to_numpy(float))
    by_lang = {}
    for lang, of in found.groupby("lang"):
        toxic = of["toxic"] > 0
        if of.loc[toxic, "count"].sum() >= MIN_TOXIC and not toxic.all():
            by_lang[lang] = best(of)
    return Model(net, best(found), by_lang)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__score``, and ``__toxic``: whether it reaches the threshold of its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        m = shared.value
        for b in batches:
            texts, s = b["text"].tolist(), np.empty(len(b))
            for at in range(0, len(b), 256):
                s[at:at + 256] = m.net.scores([word_ids(t) for t in texts[at:at + 256]])
            limit = b["lang"].map(lambda x: m.by_lang.get(x, m.threshold)).to_numpy(float) if len(b) else np.zeros(0)
            b["__score"], b["__toxic"] = s, s >= limit
            yield b
    return docs.mapInPandas(run, types + ", __score double, __toxic boolean")
