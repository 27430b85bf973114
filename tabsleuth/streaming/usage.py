"""Streaming roll-ups over arriving result files (ST1, ST2).

The reference re-aggregates its logs after every finished question.  Here a
file-source stream over the results folder keeps one state for each question: the
records seen (by sc_id; their number is the fan-out of self-consistency) with their
normalised answers.  A re-delivered record changes nothing; a new one changes the
question's vote.  Each micro-batch emits only the questions that it changed, with what
they add to the token totals, and writes them as a batch of its own, so what is
written is bounded by the changed ids and a repeated batch replaces itself.
States of questions without a new record for ``expire_ms`` are dropped, if
that is set.  The checkpoint in the shared folder lets a restarted query go on where it stopped.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import answers as A
from ..sources.files import RESULT_SCHEMA

_SCHEMA = T.StructType([f for f in RESULT_SCHEMA.fields if f.name != "_corrupt_record"])
_STATE = "seen string"           # JSON: [sc_ids, answers, labels]
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_CHANGE = "id string, pred string, label string, n_seen long, input_tokens long, output_tokens long, total_tokens long, n_records long"


def _vote(sc: list, answers: list, labels: list) -> tuple:
    """The most frequent answer, among equals that of the smallest sc_id; the label of the smallest sc_id."""
    seen: dict = {}
    for s, a in sorted(zip(sc, answers), key=lambda x: x[0]):
        n, first = seen.get(a, (0, s))
        seen[a] = (n + 1, first)
    given = {a: v for a, v in seen.items() if a is not None}
    pred = max(given, key=lambda a: (given[a][0], -given[a][1])) if given else None
    return pred, min(zip(sc, range(len(sc)), labels))[2]


def _changes(expire_ms: int | None):
    def update(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        sc, answers, labels = json.loads(state.get[0]) if state.exists else ([], [], [])
        known = set(sc)
        tokens = [0, 0, 0, 0]
        for b in batches:
            for r in b.itertuples(index=False):
                if r.sc_id in known:
                    continue
                known.add(r.sc_id)
                sc.append(int(r.sc_id))
                answers.append(r.na if isinstance(r.na, str) else None)
                labels.append(r.nl if isinstance(r.nl, str) else None)
                tokens = [tokens[0] + int(r.i), tokens[1] + int(r.o), tokens[2] + int(r.t), tokens[3] + 1]
        if tokens[3]:
            state.update((json.dumps([sc, answers, labels]),))
            if expire_ms:
                state.setTimeoutDuration(expire_ms)
            yield pd.DataFrame([(key[0], *_vote(sc, answers, labels), len(sc), *tokens)],
                               columns=["id", "pred", "label", "n_seen", "input_tokens", "output_tokens", "total_tokens", "n_records"])
    return update


def run_changes(spark: SparkSession, path: str, checkpoint: str, out_path: str, expire_ms: int | None = None, files_per_batch: int = 4) -> None:
    """Read the available result files and write each micro-batch's changed questions under ``out_path``/epoch=n."""
    s = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path).where("id is not null and sc_id is not null")
    i, o = (F.coalesce(F.col(c), F.lit(0)) for c in ("input_token_count", "output_token_count"))
    rows = s.select("id", "sc_id", A.normalize_answer(F.col("answer")).alias("na"), A.normalize_answer(F.col("label")).alias("nl"),
                    i.alias("i"), o.alias("o"), F.coalesce(F.col("total_token_count"), i + o).alias("t"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire_ms else GroupStateTimeout.NoTimeout
    changed = rows.groupBy("id").applyInPandasWithState(_changes(expire_ms), _CHANGE, _STATE, "update", timeout)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    # Expired states go in batches that have data: batches for them alone would follow one another without end.
    before = spark.conf.get(_EMPTY_BATCHES, None)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        q = (changed.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(_EMPTY_BATCHES)
        else:
            spark.conf.set(_EMPTY_BATCHES, before)
    q.awaitTermination()


def _written(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.schema(_CHANGE + ", epoch long").parquet(out_path)


def running_usage(spark: SparkSession, path: str, checkpoint: str, out_path: str, **options) -> DataFrame:
    """ST1: running token totals: the sum of what every batch added."""
    run_changes(spark, path, checkpoint, out_path, **options)
    return _written(spark, out_path).agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "n_records")])


def running_vote(spark: SparkSession, path: str, checkpoint: str, out_path: str, **options) -> DataFrame:
    """ST2: the running majority vote of each question: its last written change."""
    run_changes(spark, path, checkpoint, out_path, **options)
    last = _written(spark, out_path).groupBy("id").agg(F.max_by(F.struct("pred", "label"), "epoch").alias("v"))
    return last.select("id", "v.pred", "v.label", (F.col("v.pred") == F.col("v.label")).alias("correct"))
