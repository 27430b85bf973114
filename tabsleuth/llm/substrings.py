"""Exact removal of byte strings that occur more than once, by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere
else too, in the same document or another one.

Every string of ``LENGTH`` bytes has one fingerprint: the smallest hash among
its grams of ``GRAM`` bytes, with its place.  Equal strings have equal
fingerprints at equal places, so strings need to be compared only where their
fingerprint occurs again.  The strings of one fingerprint occurrence start at
consecutive places; the bytes they cover are its context.  Equal contexts are
sent once with their number: all strings of a context that occurs again do so
too.  Contexts are dealt by fingerprint into shards of bounded size.  Of a
fingerprint with several contexts, one copy of each enters the shard's suffix
array: suffixes are sorted by induced sorting, and runs whose permuted common
prefixes reach ``LENGTH`` are equal strings.  Strings that start in a context
are its own, so each is counted once.

A fingerprint with more than ``MANY`` different contexts (the edge of a
passage in very many documents) would outgrow a shard; the strings of such
contexts are counted by their hashes instead, which any number of tasks share.

Defined cases: a null text has no bytes; rows equal in id and text are two
documents with equal strings and one result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, materialize
from .suffixes import reaching, suffix_array, window_hashes
from .words import mix64

LENGTH = 400
GRAM = 64
#: Bytes of a shard's text, about.
SHARD_BYTES = 2 << 20
MANY = 4096
#: No UTF-8 text holds it.
SEPARATOR = 0xFF


def winnow(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(fingerprint, first start, last start) of the document's fingerprint occurrences, in order."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix64(window_hashes(data, gram))
    w = length - gram + 1
    # The smallest hash of w grams in a row, the leftmost of equal ones: minima from block borders both ways.
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // w)
    grid = np.full(blocks * w, np.uint64(2 ** 64 - 1))
    grid[:len(key)] = key
    grid = grid.reshape(blocks, w)
    upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
    onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(onward[:n], upto[w - 1:w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    return h[place[first]], first, last


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)


def _fingerprints(batches):
    for b in batches:
        at = 0
        while at < len(b):
            size, end = 0, at
            while end < len(b) and (end == at or size < 32 << 20):
                size += len(b["text"].iloc[end] or "")
                end += 1
            found = [winnow(_bytes(t))[0] for t in b["text"].iloc[at:end]]
            rows = np.repeat(np.arange(at, end), [len(f) for f in found])
            out = b[["id", "h1", "h2"]].iloc[rows].reset_index(drop=True)
            out["f"] = np.concatenate(found).view(np.int64)
            yield out
            at = end


def _contexts(batches):
    for b in batches:
        rows, size = [], 0
        for doc, h1, h2, text, shared in b[["id", "h1", "h2", "text", "shared"]].itertuples(index=False):
            raw = text.encode()
            f, first, last = winnow(np.frombuffer(raw, np.uint8))
            f = f.view(np.int64)
            for i in np.flatnonzero(np.isin(f, np.asarray(shared, np.int64))):
                c = raw[first[i]:last[i] + LENGTH]
                x = xxhash.xxh128_intdigest(c)
                rows.append((doc, h1, h2, f[i], x >> 64, x & (2 ** 64 - 1), first[i], c))
                size += len(c)
            if size > 16 << 20:
                yield _context_rows(rows)
                rows, size = [], 0
        if rows:
            yield _context_rows(rows)


def _context_rows(rows):
    out = pd.DataFrame(rows, columns=["id", "h1", "h2", "f", "c1", "c2", "at", "context"])
    for c in ("c1", "c2"):
        out[c] = out[c].astype(np.uint64).to_numpy().view(np.int64)
    return out


def _runs(mask: np.ndarray):
    """(first, end) of the runs of True."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def repeated(contexts: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each of the different contexts, which of its strings occur more than once in all of them."""
    sep = bytes([SEPARATOR])
    t = np.frombuffer(b"".join(x for c in contexts for x in (c, sep)), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    valid = np.zeros(len(t), bool)
    for s, n in zip(starts, sizes):
        valid[s:s + n - LENGTH + 1] = True
    sa = suffix_array(t, LENGTH)
    reach = reaching(t, sa, LENGTH)[sa]
    ok = valid[sa]
    # A run of the array: each member reaches LENGTH with the one before; strings across a separator never join one.
    again = np.zeros(len(t), bool)
    same = reach[1:] & ok[1:] & ok[:-1]
    again[sa[1:][same]] = True
    again[sa[:-1][same]] = True
    return [again[s:s + n - LENGTH + 1] | (k > 1) for s, n, k in zip(starts, sizes, counts)]


_SPANS = "f long, c1 long, c2 long, spans array<struct<s:int,e:int>>"


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["f", "c1", "c2"], kind="stable")
    contexts, counts = pdf["context"].tolist(), pdf["n"].to_numpy()
    found = [np.full(len(c) - LENGTH + 1, k > 1) for c, k in zip(contexts, counts)]
    # The only context of a fingerprint shares its strings with its own copies alone.
    several = np.flatnonzero(pdf["f"].duplicated(keep=False))
    if len(several):
        for i, again in zip(several, repeated([contexts[i] for i in several], counts[several])):
            found[i] = again
    out = pdf[["f", "c1", "c2"]].copy()
    out["spans"] = [[{"s": int(s), "e": int(e)} for s, e in zip(*_runs(m))] for m in found]
    return out


def _strings(batches):
    """One row for each string of a context: place and 128 bits of hash."""
    for b in batches:
        for at in range(0, len(b), 2000):
            some = b.iloc[at:at + 2000]
            hashes = []
            for c in some["context"]:
                x = np.frombuffer(c, np.uint8)
                hashes.append((window_hashes(x, LENGTH), window_hashes(x ^ np.uint8(0x55), LENGTH)))
            sizes = [len(h[0]) for h in hashes]
            out = some[["f", "c1", "c2", "n"]].iloc[np.repeat(np.arange(len(some)), sizes)].reset_index(drop=True)
            out["place"] = np.concatenate([np.arange(n) for n in sizes])
            out["s1"] = mix64(np.concatenate([h[0] for h in hashes])).view(np.int64)
            out["s2"] = mix64(np.concatenate([h[1] for h in hashes])).view(np.int64)
            yield out


def _by_hash(contexts: DataFrame) -> DataFrame:
    """Spans of contexts whose fingerprint has too many of them for a shard."""
    s = materialize(contexts.mapInPandas(_strings, "f long, c1 long, c2 long, n long, place int, s1 long, s2 long"), "sub-strings")
    again = materialize(s.groupBy("s1", "s2").agg(F.sum("n").alias("times")).where("times > 1").select("s1", "s2"), "sub-again")
    places = s.join(again, ["s1", "s2"], "left_semi").groupBy("f", "c1", "c2").agg(F.sort_array(F.collect_set("place")).alias("p"))
    one = F.transform("p", lambda x: F.struct(x.alias("s"), (x + 1).alias("e")))
    return places.select("f", "c1", "c2", one.alias("spans"))


def _cut(batches):
    for b in batches:
        rows = []
        for doc, text, spans in b[["doc_id", "text", "__spans"]].itertuples(index=False):
            raw = (text or "").encode()
            edge = np.zeros(len(raw) + 1, np.int64)
            for x in () if spans is None else spans:
                edge[x["s"]] += 1
                edge[min(len(raw), x["e"] - 1 + LENGTH)] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            first, _ = _runs(gone)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc, len(raw), int(gone.sum()), len(first), hashlib.sha256(kept).hexdigest(), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_key().alias("key"))
    prints = d.select("key.*", "text").mapInPandas(_fingerprints, "id long, h1 long, h2 long, f long")
    prints = materialize(prints, "sub-prints")
    again = materialize(prints.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"), "sub-shared")
    shared = (prints.join(again, "f", "left_semi").groupBy(F.struct("id", "h1", "h2").alias("__key"))
              .agg(F.collect_set("f").alias("shared")))
    contexts = (d.join(shared, F.col("key") == F.col("__key")).select("key.*", "text", "shared")
                .mapInPandas(_contexts, "id long, h1 long, h2 long, f long, c1 long, c2 long, at int, context binary"))
    contexts = materialize(contexts, "sub-contexts")
    distinct = contexts.groupBy("f", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.any_value("context").alias("context"))
    distinct = materialize(distinct, "sub-distinct")
    many = materialize(distinct.groupBy("f").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MANY).select("f"), "sub-many")
    size = distinct.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    few = distinct.join(many, "f", "left_anti").withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards)))
    spans = few.groupBy("shard").applyInPandas(_shard, _SPANS)
    spans = spans.unionByName(_by_hash(distinct.join(many, "f", "left_semi"))).where(F.size("spans") > 0)
    spans = materialize(spans, "sub-spans")
    names = spans.select(F.col("f").alias("__f"), F.col("c1").alias("__1"), F.col("c2").alias("__2"), "spans")
    placed = contexts.select("id", "h1", "h2", "f", "c1", "c2", "at").join(
        names, (F.col("f") == F.col("__f")) & (F.col("c1") == F.col("__1")) & (F.col("c2") == F.col("__2")))
    placed = placed.select(F.struct("id", "h1", "h2").alias("__key"), F.transform("spans", lambda x: F.struct(
        (x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e"))).alias("spans"))
    by_doc = placed.groupBy("__key").agg(F.flatten(F.collect_list("spans")).alias("__spans"))
    out = d.join(materialize(by_doc, "sub-places"), F.col("key") == F.col("__key"), "left").select("doc_id", "text", "__spans")
    return out.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
