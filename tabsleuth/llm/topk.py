"""Exact top-k inner-product search by distributed histogram selection.

Vectors become integers, floor(scale * x).  Queries and candidates are packed
into blocks of bounded size; query blocks meet groups of candidates in an
equi-join on the group number, so neither side passes through the driver and
a group of equal vectors spreads over all groups.  Every task scores its
blocks by a matrix product and keeps, per query, a histogram of the scores in
the query's open interval.  The summed histograms narrow each query's
interval around its k-th value: first over scores, then, among candidates
that tie there, over ids.  A query is settled when the interval holds no more
candidates than a few times k; a last pass emits what lies at or beyond the interval, and a
window ranks those few rows by (score descending, id ascending).

Defined cases: vectors that are null, or hold a null or a non-finite
component, or have a null id, take no part; only vectors of equal length are
compared; repeated ids are candidates of their own but never of a query with
the same id; a query with fewer than k candidates gets all of them; an empty
table gives no rows.  Scores are 64-bit integers: products are taken in
floating point only where every partial sum stays below 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BINS = 256
#: Rows of a query block and of a candidate block.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Candidates of one group: what a query's histogram of one task stands for, at least.
GROUP_ROWS = 1 << 16
#: A query is settled when so many candidates are left for each of its k places.
SETTLED = 16

_INT = np.dtype("<i8")
_BLOCK = "block long, g long, dim int, ids binary, data binary"
_STATE = "block long, query_id long, lo long, hi long, id_lo long, id_hi long, above long"
_I64 = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id, v (array of long), dim; only vectors that take part."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Beyond 2**62 a component is held at 2**62: its products have no 64-bit value.
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)),
                        F.lit(-2.0 ** 62)), F.lit(2.0 ** 62))), F.lit(-2 ** 62)), F.lit(2 ** 62)).cast("long"))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(v).alias("dim"))


def _packer(rows: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block, dim = int(key[0]), int(key[1])
        out = []
        pdf = pdf.sort_values("id", kind="stable")
        for at in range(0, len(pdf), rows):
            part = pdf.iloc[at:at + rows]
            m = np.vstack([np.asarray(x, dtype=_INT) for x in part["v"]]) if dim else np.empty((len(part), 0), _INT)
            out.append((block, block, dim, part["id"].to_numpy(_INT).tobytes(), m.tobytes()))
        return pd.DataFrame(out, columns=["block", "g", "dim", "ids", "data"])
    return run


def _matrix(ids, data, dim):
    i = np.frombuffer(ids, _INT)
    return i, np.frombuffer(data, _INT).reshape(len(i), dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    top = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if top < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def bin_edges(lo: int, hi: int) -> int:
    """Width of a bin such that BINS bins cover lo..hi."""
    return (hi - lo) // BINS + 1


def _open_ids(s, lo_ids, hi_ids, cand, lo, hi):
    """Candidates in the open interval: score strictly inside lo..hi, or, once that is one value, id inside."""
    inside = (s >= lo) & (s <= hi)
    if lo == hi:
        inside &= (cand >= lo_ids) & (cand <= hi_ids)
    return inside


def _histograms(batches):
    """(block, dim, q_ids, q_data, state columns, ids, data) -> query_id, counts by bin."""
    kept: dict[tuple, np.ndarray] = {}

    def flush():
        rows = [(b, q, c.astype("<i8").tobytes()) for (b, q), c in kept.items()]
        kept.clear()
        return pd.DataFrame(rows, columns=["block", "query_id", "counts"])

    for batch in batches:
        for r in batch.itertuples(index=False):
            q_ids, q = _matrix(r.q_ids, r.q_data, r.dim)
            ids, c = _matrix(r.ids, r.data, r.dim)
            state = np.frombuffer(r.state, _INT).reshape(-1, 7)
            place = {int(x): i for i, x in enumerate(q_ids)}
            at = np.array([place[int(x)] for x in state[:, 1]], dtype=np.int64)
            s = _scores(q[at], c)
            for i, (block, query, lo, hi, id_lo, id_hi, _) in enumerate(state.tolist()):
                row = s[i]
                inside = _open_ids(row, id_lo, id_hi, ids, lo, hi) & (ids != query)
                if lo == hi:
                    x = (ids[inside].astype(object) - id_lo) // bin_edges(id_lo, id_hi) if id_hi - id_lo > 2 ** 62 \
                        else (ids[inside] - id_lo) // bin_edges(id_lo, id_hi)
                else:
                    x = (row[inside] - lo) // bin_edges(lo, hi)
                if len(x):
                    n = np.bincount(np.asarray(x, dtype=np.int64), minlength=BINS)
                    k = (block, query)
                    kept[k] = kept[k] + n if k in kept else n
            if len(kept) >= 16_384:
                yield flush()
    if kept:
        yield flush()


def _sum_counts(c: pd.Series) -> bytes:
    return np.sum([np.frombuffer(x, _INT) for x in c], axis=0).astype("<i8").tobytes()


def _narrow(k: int):
    """State and summed counts -> next state.  From the best bin on, counts are added to
    ``above`` until the k-th candidate's bin is reached; that bin is the next interval."""
    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                lo, hi, id_lo, id_hi, above = int(r.lo), int(r.hi), int(r.id_lo), int(r.id_hi), int(r.above)
                n = np.zeros(BINS, np.int64) if r.counts is None else np.frombuffer(r.counts, _INT)
                by_id = lo == hi
                width = bin_edges(id_lo, id_hi) if by_id else bin_edges(lo, hi)
                order = np.arange(BINS) if by_id else np.arange(BINS)[::-1]
                upto = above + np.cumsum(n[order])
                hit = np.flatnonzero(upto >= k)
                if len(hit):
                    j = int(order[hit[0]])
                    above, left = int(upto[hit[0]] - n[j]), int(n[j])
                    if by_id:
                        id_lo, id_hi = id_lo + j * width, min(id_hi, id_lo + (j + 1) * width - 1)
                    else:
                        lo, hi = lo + j * width, min(hi, lo + (j + 1) * width - 1)
                    settled = above + left <= SETTLED * k or (lo == hi and id_lo == id_hi)
                else:
                    settled = True             # fewer than k candidates: all of them
                rows.append((r.block, r.query_id, lo, hi, id_lo, id_hi, above, settled))
            yield pd.DataFrame(rows, columns=[*_STATE.replace(" long", "").split(", "), "settled"])
    return run


def _emit(batches):
    """Pairs at or beyond a settled interval."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            q_ids, q = _matrix(r.q_ids, r.q_data, r.dim)
            ids, c = _matrix(r.ids, r.data, r.dim)
            state = np.frombuffer(r.state, _INT).reshape(-1, 7)
            place = {int(x): i for i, x in enumerate(q_ids)}
            at = np.array([place[int(x)] for x in state[:, 1]], dtype=np.int64)
            s = _scores(q[at], c)
            keep = s >= state[:, 2][:, None]
            tie = (state[:, 2] == state[:, 3])[:, None] & (s == state[:, 2][:, None])
            keep &= ~(tie & (ids[None, :] > state[:, 5][:, None])) & (ids[None, :] != state[:, 1][:, None])
            i, j = np.nonzero(keep)
            yield pd.DataFrame({"query_id": state[i, 1], "vec_id": ids[j], "score": s[i, j]})


def _packed_state(pdf: pd.DataFrame) -> pd.DataFrame:
    m = pdf[_STATE.replace(" long", "").split(", ")].sort_values("query_id").to_numpy(_INT)
    return pd.DataFrame({"block": [int(m[0, 0])], "state": [m.tobytes()]})


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row where ``is_query(id)`` holds."""
    spark = vectors.sparkSession
    v = materialize(quantised(vectors, id_col, vec_col, scale), "topk-vectors")
    top = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = v.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("id"))).alias("q"), F.max(top).alias("sq"),
                  F.min("id").alias("id_lo"), F.max("id").alias("id_hi")).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], out_schema)
    groups = max(1, -(-stats["n"] // GROUP_ROWS))
    # Several tasks for each core while the table is small: groups are the unit of work.
    groups = max(groups, min(spark.sparkContext.defaultParallelism, -(-stats["n"] // CANDIDATE_ROWS)))
    blocks = max(1, -(-stats["q"] // QUERY_ROWS))
    # Cauchy-Schwarz: no score lies outside the product of the largest norms.
    reach = min(int(math.ceil(stats["sq"])) + 1, 2 ** 62)

    by_g = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long")
    cands = v.withColumn("b", by_g).withColumn("slice", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(-(-stats["n"] // (groups * CANDIDATE_ROWS)))))
    cands = cands.groupBy("b", "dim", "slice").applyInPandas(_packer(CANDIDATE_ROWS), _BLOCK)
    cands = materialize(cands.select("g", "dim", "ids", "data"), "topk-candidates")
    queries = v.where(is_query(F.col("id"))).dropDuplicates(["id", "v"])
    # One query per id: of several vectors with one id, the first in order.
    queries = queries.groupBy("id").agg(F.min_by(F.struct("v", "dim"), F.xxhash64("v")).alias("x")).select("id", "x.v", "x.dim")
    queries = queries.withColumn("b", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(blocks)) * F.lit(1 << 31) + F.col("dim"))
    q_state = materialize(queries.select(F.col("b").alias("block"), F.col("id").alias("query_id"), F.lit(-reach).alias("lo"), F.lit(reach).alias("hi"),
                             F.lit(stats["id_lo"]).alias("id_lo"), F.lit(stats["id_hi"]).alias("id_hi"), F.lit(0).cast("long").alias("above"),
                             F.lit(False).alias("settled")), "topk-state")
    packed = queries.groupBy("b", "dim").applyInPandas(_packer(1 << 30), _BLOCK)
    packed = materialize(packed.select("block", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "topk-queries")
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q_g")

    def pairs(state: DataFrame) -> DataFrame:
        s = state.drop("settled").groupBy("block").applyInPandas(_packed_state, "block long, state binary")
        q = packed.join(s, "block").select("q_dim", "q_ids", "q_data", "state", all_groups)
        return (cands.join(q, (F.col("g") == F.col("q_g")) & (F.col("dim") == F.col("q_dim")))
                .select("dim", "q_ids", "q_data", "state", "ids", "data"))

    add = F.pandas_udf(_sum_counts, "binary")
    finished: list[DataFrame] = []
    while True:
        counts = pairs(q_state).mapInPandas(_histograms, "block long, query_id long, counts binary")
        counts = counts.groupBy("block", "query_id").agg(add("counts").alias("counts"))
        step = (q_state.drop("settled").join(counts, ["block", "query_id"], "left")
                .mapInPandas(_narrow(k), _STATE + ", settled boolean"))
        step = materialize(step, "topk-state")
        finished.append(step.where("settled"))
        q_state = step.where("not settled")
        if q_state.isEmpty():
            break
    settled = finished[0]
    for d in finished[1:]:
        settled = settled.unionByName(d)
    found = pairs(settled).mapInPandas(_emit, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
