"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, ``-ln(u) / quality``; ``u`` is a
hash of the document id, so reruns and retries agree.  A source whose target
is ``e`` times its size plus a rest takes ``e`` complete epochs of all its
documents; the rest is filled by the documents of smallest key, whose sizes
are prefix-summed up to the budget.  Of the one document in which the budget
ends only the first words are taken, so a source meets its target exactly,
but for the fraction of a word.

The prefix sum never sees a source in one task: documents are range-sorted by
(source, key), sums of the partitions give each partition's offset, and only
the inside of a partition is summed by a window.  Only DataFrame functions
are used.

Defined cases: a null text has size 0; a null source is a source of its own;
rows equal in id and text share one key and what is taken of it evenly; a source of
size 0 has target 0; an empty table gives no rows.  Columns other than
``doc_id``, ``text`` and ``source`` are ignored by `mix` and kept by `sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, materialize, shuffle_parts

#: A token is a run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
#: Sampling weight of a document by its quality label; the last is for documents without one.
QUALITY = {1: 1.0, 0: 0.25, None: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def uniform(seed: str, ident: Column) -> Column:
    """A number in (0, 1) from 52 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> + target.  ``weights`` repeat over the sources in
    code-point order, null last.

    With the caps sorted by cap / weight, the capped sources are a prefix:
    a source is capped if its ratio does not exceed what is left over the
    weight that is left.  One row per source is sorted, not the documents."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("__ratio", "__n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = (sizes.withColumn("__n", n).withColumn("__w", weight).withColumn("__cap", cap)
         .withColumn("__ratio", F.col("__cap") / F.col("__w"))
         .withColumn("__level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
                     / F.sum("__w").over(after)))
    t = (t.withColumn("__capped", F.col("__ratio") <= F.col("__level"))
         .withColumn("__share", F.min(F.when(~F.col("__capped"), F.struct("__ratio", "__n", "__level"))).over(Window.partitionBy())))
    return t.select("source", "source_size",
                    F.when(F.col("__capped"), F.col("__cap"))
                    .otherwise(F.col("__share.__level") * F.col("__w")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: str = "mix-1") -> DataFrame:
    """One row per distinct document: ``key`` (see `doc_key`), ``doc_id``, ``source``,
    ``size``, ``rows`` (copies of the row), ``source_size``, ``target``, and what the mix
    takes of each row: ``epochs`` times all of it and ``part_words`` words more (up to
    ``size``).  ``quality`` has doc_id and weight (positive)."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    word_count(F.col("text")).alias("size"), doc_key().alias("key"))
    d = d.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.first("doc_id").alias("doc_id"))
    d = materialize(d, "mix-sizes")
    if quality is not None:
        d = d.join(quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").alias("__weight")),
                   "doc_id", "left")
    else:
        d = d.withColumn("__weight", F.lit(None).cast("double"))
    d = d.withColumn("draw", -F.log(uniform(seed, F.col("doc_id"))) / F.coalesce("__weight", F.lit(QUALITY[None])))
    order = ["source", "draw", "key"]
    d = (d.drop("__weight").repartitionByRange(shuffle_parts(spark), *order)
         .withColumn("part", F.spark_partition_id()))
    d = materialize(d, "mix-sorted")
    sums = d.groupBy("part", "source").agg(F.sum(F.col("size") * F.col("rows")).alias("__sum"))
    sums = materialize(sums, "mix-parts")
    sizes = sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
               .select(F.col("part").alias("__part"), F.col("source").alias("__source"), "__offset"))
    offsets = offsets.join(targets.withColumnRenamed("source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    inside = Window.partitionBy("part", "source").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unit = F.col("size") * F.col("rows")
    d = (d.withColumn("__in", F.sum(unit).over(inside))
         .join(offsets, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__source"))))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0)
    rest = F.floor(F.col("target") - F.col("__epochs") * F.col("source_size"))
    before = F.col("__offset") + F.col("__in") - unit
    part_of_row = F.floor(F.greatest(F.lit(0), F.least(unit, rest - before)) / F.col("rows"))
    return (d.withColumn("__epochs", epochs.cast("long"))
            .select("key", "doc_id", "source", "size", "rows", "source_size", "target",
                    F.col("__epochs").alias("epochs"), part_of_row.cast("long").alias("part_words")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, as it is written."""
    ends = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    return F.array_join(F.slice(F.split(text, ends), F.lit(1), n.cast("int")), "")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, the last perhaps in part;
    all columns are kept."""
    taken = mix(docs, **options).where("epochs > 0 or part_words > 0")
    taken = taken.groupBy(F.col("key").alias("__taken"), F.col("source").alias("__source")).agg(
        F.max("epochs").alias("__epochs"), F.max("part_words").alias("__part"), F.max("size").alias("__size"))
    cols = docs.columns
    out = docs.withColumn("__key", doc_key())
    out = out.join(taken, (F.col("__key") == F.col("__taken")) & F.col("source").cast("string").eqNullSafe(F.col("__source")))
    copies = F.col("__epochs") + F.when(F.col("__part") > 0, 1).otherwise(0)
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    cut = (F.col("__copy") > F.col("__epochs")) & (F.col("__part") < F.col("__size"))
    out = out.withColumn("text", F.when(cut, first_words(F.col("text"), F.col("__part"))).otherwise(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in cols])


def label_quality(labels: DataFrame) -> DataFrame:
    """doc_id, weight from ``labels.quality``; the best label of an id counts, null labels do not."""
    w = F.when(F.col("quality") > 0, QUALITY[1]).otherwise(QUALITY[0])
    return (labels.where("doc_id is not null and quality is not null")
            .groupBy("doc_id").agg(F.max(w).alias("weight")))
