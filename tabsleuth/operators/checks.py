"""Assertions as data (F14-F16, A10, U2): one row per check with the
expected and the actual value, computed in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(name: str, expected: DataFrame | int, actual: DataFrame) -> DataFrame:
    """One row (check_name, expected, actual, ok).  ``expected`` is a number or,
    like ``actual``, a frame of one row and one column."""
    rows = actual.toDF("v").select(F.lit(1).alias("side"), F.col("v").cast("long").alias("v"))
    if isinstance(expected, DataFrame):
        rows = rows.unionByName(expected.toDF("v").select(F.lit(0).alias("side"), F.col("v").cast("long").alias("v")))
        want = F.max(F.when(F.col("side") == 0, F.col("v")))
    else:
        want = F.lit(expected).cast("long")
    out = rows.agg(want.alias("expected"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("actual"))
    return out.select(F.lit(name).alias("check_name"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("ok"))


def count_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("v"))


def unique(name: str, df: DataFrame, key: str) -> DataFrame:
    """every key once."""
    return check(name, count_of(df), df.agg(F.count_distinct(key).alias("v")))


def exists(name: str, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """no row of ``left`` without its key in ``right``."""
    return check(name, 0, count_of(left.join(right, left[left_key] == right[right_key], "left_anti")))


def complete(name: str, df: DataFrame, key: str) -> DataFrame:
    """A10: the keys are 0..n-1 (the number of those that are missing)."""
    return check(name, 0, df.where(F.col(key) >= 0).agg((F.max(key) + 1 - F.count_distinct(key)).alias("v")))


def same_set(name: str, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(F.col(left_key).alias("k")).distinct(), right.select(F.col(right_key).alias("k")).distinct()
    return check(name, 0, count_of(a.exceptAll(b).unionByName(b.exceptAll(a))))


def run(checks: list[DataFrame], strict: bool = False) -> DataFrame:
    """All checks as one frame; with ``strict`` a failed one fails the query."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    if strict:
        failed = F.raise_error(F.concat(F.lit("failed check: "), F.col("check_name"))).cast("boolean")
        out = out.withColumn("ok", F.when(F.coalesce("ok", F.lit(False)), F.lit(True)).otherwise(failed))
    return out
