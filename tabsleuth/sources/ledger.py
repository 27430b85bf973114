"""Keyed append of result records (K2, F8, U4).

A ledger is a folder of written batches and a manifest with a row for each committed
batch.  ``append`` writes only records whose key (id, sc_id) no committed
batch holds, as a new batch, and then commits it by a manifest entry; a run that
ends before that leaves a folder that no reader sees, so running it again adds nothing
twice.  ``compact`` rewrites all batches as one and commits the list that it replaces; the
old batches stay readable for readers that began before.  Transcripts are
written beside the records under the same batch and key.

Entries are read by Spark, one row for each batch; records never pass through
the driver.  One writer appends at a time; if two did, `read` would keep a key's record
of the earlier batch.

Defined cases: a record with a null id or sc_id has that null as its key; of equal keys in one
append the record of smallest content is kept; an append without new records commits
no batch; a new ledger has no records.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

KEYS = ("id", "sc_id")
_ENTRY = "number long, batch string, n_records long, has_transcripts boolean, replaces array<string>"


def _entries(spark: SparkSession, path: str) -> list:
    """Committed batches in order, replaced ones left out: a row for each batch."""
    try:
        rows = spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").json(f"{path}/manifest").orderBy("number").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    gone = {b for r in rows for b in r["replaces"] or []}
    return [r for r in rows if r["batch"] not in gone]


def _commit(spark: SparkSession, path: str, entries: list, batch: str, n: int, transcripts: bool, replaces: list[str]) -> None:
    number = max((r["number"] for r in entries), default=-1) + 1
    entry = spark.createDataFrame([(number, batch, n, transcripts, replaces)], _ENTRY).coalesce(1)
    entry.write.mode("errorifexists").json(f"{path}/manifest/{number:08d}-{batch}")


def _batches(spark: SparkSession, path: str, entries: list, folder: str) -> DataFrame | None:
    found = None
    for r in entries:
        if folder == "records" or r["has_transcripts"]:
            part = spark.read.parquet(f"{path}/{folder}/{r['batch']}").withColumn("_number", F.lit(r["number"]))
            found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def read(spark: SparkSession, path: str, folder: str = "records", keys=KEYS) -> DataFrame | None:
    """The committed records (or ``transcripts``), one for each key; None of a new ledger."""
    entries = _entries(spark, path)
    rows = _batches(spark, path, entries, folder)
    if rows is None or len(entries) == 1:
        return rows if rows is None else rows.drop("_number")
    w = Window.partitionBy(*keys).orderBy("_number")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_number")


def append(results: DataFrame, path: str, keys=KEYS, transcript: str | None = None) -> int:
    """Commit the records whose key is new; returns their number.  The column ``transcript`` goes to a
    folder of its own."""
    spark = results.sparkSession
    keys = list(keys)
    entries = _entries(spark, path)
    whole = [c for c in results.columns if c not in keys]
    one = results.groupBy(*keys).agg(F.min(F.struct(*whole)).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in whole])
    done = _batches(spark, path, entries, "records")
    if done is not None:
        done = done.select(*[F.col(c).alias(f"_{c}") for c in keys])
        one = one.join(done, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), "left_anti")
    new = materialize(one, "ledger-new")
    n = new.count()
    if n:
        batch = uuid.uuid4().hex
        if transcript is not None:
            new.select(*keys, transcript).write.mode("errorifexists").parquet(f"{path}/transcripts/{batch}")
            new = new.drop(transcript)
        new.write.mode("errorifexists").parquet(f"{path}/records/{batch}")
        _commit(spark, path, entries, batch, n, transcript is not None, [])
    return n


def compact(spark: SparkSession, path: str, keys=KEYS) -> None:
    """All committed batches as one."""
    entries = _entries(spark, path)
    if len(entries) < 2:
        return
    batch = uuid.uuid4().hex
    rows = read(spark, path, "records", keys)
    rows.write.mode("errorifexists").parquet(f"{path}/records/{batch}")
    texts = read(spark, path, "transcripts", keys)
    if texts is not None:
        texts.write.mode("errorifexists").parquet(f"{path}/transcripts/{batch}")
    _commit(spark, path, entries, batch, sum(r["n_records"] for r in entries), texts is not None, [r["batch"] for r in entries])


def run_pending(tasks: DataFrame, path: str, answer, keys=KEYS, transcript: str | None = None) -> DataFrame:
    """F8 U4: answer the tasks that have no committed record, append the answers, and return old and
    new records together.  ``answer`` maps the open tasks to records."""
    spark = tasks.sparkSession
    done = read(spark, path, "records", keys)
    open_tasks = tasks if done is None else tasks.join(done.select(*keys), list(keys), "left_anti")
    append(answer(open_tasks), path, keys, transcript)
    return read(spark, path, "records", keys)
