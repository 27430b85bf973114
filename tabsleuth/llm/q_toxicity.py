"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import toxicity
from .common import held_out, table


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", F.col("__score").alias("score"),
                      F.when(F.col("__score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
                      F.col("__toxic").alias("rejected"))
