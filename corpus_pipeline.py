"""The corpus pipeline: five stages, each applying one training-data operator to what the stage before kept.

Every stage but the last returns the columns of documents; texts that a stage
shortens carry their new ``n_chars``.  ``run`` writes each stage's documents
to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsleuth.llm import lines, mixing, neardup, packing, toxicity
from tabsleuth.llm.common import materialize, table
from tabsleuth.session import ship_package


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` of the present text."""
    if "n_chars" in like.columns:
        df = df.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language.  The
    classifier learns from the labels of the documents that reach this stage."""
    ship_package(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not __toxic").select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line at its earliest place only; a document that loses all its lines goes."""
    ship_package(spark)
    left = lines.dedup(docs).where("__removed = 0 or text rlike '[^ \\t\\r\\n]'")
    return _columns(left, docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    ship_package(spark)
    return neardup.keep_one(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return _columns(mixing.sample(docs, quality=mixing.label_quality(table(spark, sf_dir, "labels"))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("dedup_lines", dedup_lines),
    ("dedup_documents", dedup_documents),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: A trained classifier, weighted sampling and a tokeniser have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
