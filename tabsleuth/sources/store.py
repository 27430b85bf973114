"""Written tables in the shared folder (lineage cuts, the persisted index).

Long plans (many tables unioned, corpora reused by several joins) are cut by
writing an intermediate as parquet under ``spark.checkpoint.dir`` and
reading it back: the plan after the cut is a plain scan with file
statistics, which AQE uses for its join choices.  Each call writes a new
folder; nothing is overwritten in place.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _INSIDE = threading.Lock(), {"n": 0, "before": None}


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files of the actions in this block go with the action.  Several threads may be inside; the last one restores the setting."""
    with _LOCK:
        if _INSIDE["n"] == 0:
            _INSIDE["before"] = spark.conf.get(_CLEAN, None) if _CLEAN in spark.conf.getAll else None
            spark.conf.set(_CLEAN, "true")
        _INSIDE["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _INSIDE["n"] -= 1
            if _INSIDE["n"] == 0:
                if _INSIDE["before"] is None:
                    spark.conf.unset(_CLEAN)
                else:
                    spark.conf.set(_CLEAN, _INSIDE["before"])


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] | None = None,
                sort_within: Sequence[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    w = out.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with _cleaning(spark):          # nothing reads them after the write
        w.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input over the cluster before per-row heavy work
    (tokenizing, normalising, embedding).

    A table stored as fewer files than the default parallelism (often one
    file with one row group) is read by a single task; such inputs are
    repartitioned.  Large inputs -- more files than cores -- are left
    alone, so no raw text is shuffled at scale."""
    par = df.sparkSession.sparkContext.defaultParallelism
    try:
        n_files = len(df.inputFiles())
    except Exception:  # noqa: BLE001 - not a file-based plan
        return df
    return df.repartition(par) if 0 < n_files < par else df
