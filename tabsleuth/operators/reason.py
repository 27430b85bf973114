"""Batched reasoning rounds (L3).

All open (question, run) pairs advance one round per pass: the prompt plus
transcript goes to a model function (Arrow batches through ``mapInPandas``),
the reply is parsed JVM-side (final answer / action), actions are answered
by a DataFrame function, and the transcript grows.  The state is written to
the shared checkpoint folder after each round, so lineage stays one round
long and a lost executor recomputes one round at most.  Model calls are
keyed by (id, sc_id, round): a re-run task asks the same question again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions.answers import format_answer
from ..sources.store import materialize

STATE_COLUMNS = ["id", "sc_id", "prompt", "transcript", "round", "done", "answer", "table_source"]


def start(questions: DataFrame) -> DataFrame:
    """questions(id, sc_id, prompt) -> round-0 state."""
    return questions.select("id", "sc_id", "prompt", F.lit("").alias("transcript"),
                            F.lit(0).cast("long").alias("round"), F.lit(False).alias("done"),
                            F.lit(None).cast("string").alias("answer"),
                            F.lit(None).cast("string").alias("table_source"))


def run(state: DataFrame, model_fn: Callable, act_fn: Callable[[DataFrame], DataFrame],
        max_depth: int) -> DataFrame:
    """L3: advance until every pair is done or ``max_depth`` rounds ran.

    model_fn: iterator of pandas frames (id, sc_id, round, text) -> (id,
    sc_id, round, reply).  act_fn: DataFrame(id, sc_id, code) -> (id, sc_id,
    observation)."""
    for _ in range(max_depth):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        req = open_.select("id", "sc_id", "round", F.concat("prompt", "transcript").alias("text"))
        replies = req.mapInPandas(model_fn, "id string, sc_id long, round long, reply string")
        # replies are parsed once and written with the round (model calls
        # are not repeated on a retry); later steps read plain columns
        parsed = (replies.withColumn("p", P.parse_final(F.col("reply")))
                  .select("id", "sc_id", "reply", P.parse_action(F.col("reply")).alias("code"),
                          P.is_terminal(F.col("reply"), F.col("p.ok")).alias("term"),
                          F.when(F.col("p.ok"), format_answer(F.col("p.answer"), F.col("p.answer_raw"))).alias("ans"),
                          F.col("p.table_source").alias("src")))
        parsed = materialize(parsed, "react-replies")
        obs = act_fn(parsed.where(~F.col("term")).select("id", "sc_id", "code"))
        step = (parsed.join(obs, ["id", "sc_id"], "left")
                .select("id", "sc_id", "reply", "term", "ans", "src",
                        P.observation_text(F.col("code"), F.coalesce("observation", F.lit(""))).alias("obs")))
        advanced = (open_.join(step, ["id", "sc_id"])
                    .select("id", "sc_id", "prompt",
                            F.concat("transcript", F.lit("\n"), P.stop_cut(F.col("reply")),
                                     F.when(~F.col("term"), F.concat(F.lit("\nObservation: "), F.col("obs")))
                                     .otherwise(F.lit(""))).alias("transcript"),
                            (F.col("round") + 1).alias("round"), F.col("term").alias("done"),
                            F.col("ans").alias("answer"), F.col("src").alias("table_source")))
        state = materialize(state.where(F.col("done")).unionByName(advanced), "react-state")
    return state.withColumnRenamed("round", "n_iter")
