"""Query of the exact substring dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import substrings
from .common import table


def query(spark, sf_dir):
    """The contract's columns and ``text``, what is left to read: bytes cut inside a character show as U+FFFD."""
    kept = substrings.dedup(table(spark, sf_dir, "documents"))
    return kept.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
