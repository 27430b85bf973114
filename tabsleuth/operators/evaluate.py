"""Evaluation.

Input is the ``results`` DataFrame, one record per (id, sc_id).  Every
aggregate is keyed by question id or is a global summary with partial
aggregation: no group is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A


def vote(results: DataFrame, answer: Column, key: str = "id", order: str = "sc_id") -> DataFrame:
    """Majority vote per question: most frequent answer; ties -> the answer
    seen first (lowest ``order``).  Two partial aggregations, no sort of a
    group."""
    counts = (results.select(key, order, answer.alias("_a"))
              .groupBy(key, "_a").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")))
    return (counts.groupBy(key)
            .agg(F.max_by("_a", F.struct(F.col("_n"), -F.col("_first"))).alias("pred")))


def first_label(results: DataFrame, label: Column, key: str = "id", order: str = "sc_id") -> DataFrame:
    """A3: the label of the first record of each question."""
    return results.groupBy(key).agg(F.min_by(label, F.col(order)).alias("label"))


def vote_qa(results: DataFrame) -> DataFrame:
    """A1 A3 A4: QA vote on normalised answers; per-id correctness."""
    norm = results.select("id", "sc_id", A.normalize_answer(F.col("answer")).alias("_na"),
                          A.normalize_answer(F.col("label")).alias("_nl"))
    p = vote(norm, F.col("_na"))
    lab = first_label(norm, F.col("_nl"))
    return p.join(lab, "id").withColumn("correct", F.col("pred") == F.col("label"))


def vote_factcheck(results: DataFrame) -> DataFrame:
    """A2 SC7: fact-check vote on raw answers, then yes/no against 1/0."""
    p = vote(results, F.col("answer").cast("string"))
    lab = first_label(results, F.col("label").cast("int"))
    return p.join(lab, "id").withColumn("correct", A.factcheck_correct(F.col("pred"), F.col("label")))


def accuracy(per_id: DataFrame) -> DataFrame:
    """A4: correct / questions."""
    return per_id.agg(F.avg(F.col("correct").cast("int")).alias("accuracy"),
                      F.count(F.lit(1)).alias("n_questions"))


QUANTILES = (0.25, 0.5, 0.75)


def _quantile_rows(vals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., q, v): exact quantiles (linear interpolation) of ``_v`` per key.

    Equal values are counted first (partial aggregation), so a hot value is one
    row.  The distinct values are range-sorted by (keys, value); running counts
    are summed inside each partition and shifted by the counts of the key in
    earlier partitions, so no task holds a key's values."""
    from ..sources.store import materialize
    k = list(keys)
    n = int(vals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = vals.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = materialize(counts.repartitionByRange(n, *k, "_v").withColumn("_p", F.spark_partition_id()), "value-counts")
    per = placed.groupBy(*k, "_p").agg(F.sum("_c").alias("_s"))
    earlier = Window.partitionBy(*k).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*k, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"),
                     F.sum("_s").over(Window.partitionBy(*k)).alias("_n"))
    inside = Window.partitionBy(*k, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_in", F.sum("_c").over(inside)).join(per, [*k, "_p"])
    ranked = ranked.withColumn("_last", F.col("_before") + F.col("_in") - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    at = [F.lit(q) * (F.col("_n") - 1) for q in QUANTILES]

    def value_at(rank):
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))
    found = ranked.groupBy(*k).agg(F.max("_n").alias("_n"), *[value_at(F.floor(h)).alias(f"_lo{i}") for i, h in enumerate(at)],
                                   *[value_at(F.ceil(h)).alias(f"_hi{i}") for i, h in enumerate(at)])
    rows = [F.struct(F.lit(q).alias("q"), (F.col(f"_lo{i}") + (at[i] - F.floor(at[i])) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias("v"))
            for i, q in enumerate(QUANTILES)]
    return found.select(*k, F.inline(F.array(*rows)))


def quartiles(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact 25/50/75 % (linear interpolation) of ``col`` per group."""
    g = list(group) or ["_g"]
    vals = df.withColumn("_g", F.lit(0)).select(*g, F.col(col).cast("double").alias("_v")).where("_v is not null")
    out = _quantile_rows(vals, g).groupBy(*g).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"q{int(q * 100)}")
                                                    for q in QUANTILES])
    return out if group else out.drop("_g")


def describe(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """A5: count, mean, sample std, min, quartiles (linear interpolation), max,
    one row per (group..., stat) with one column per input column.

    All columns are described in one pass over long (column, value) rows."""
    g = list(group)
    long = df.select(*g, F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])))
    v = F.col("_v")
    simple = {"count": F.count(v).cast("double"), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    wide = long.groupBy(*g, "_col").agg(*[e.alias(f"_{s}") for s, e in simple.items()])
    stats = wide.select(*g, "_col", F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"_{s}").alias("v")) for s in simple])))
    q = _quantile_rows(long.where("_v is not null"), [*g, "_col"])
    stats = stats.unionByName(q.select(*g, "_col", F.concat((F.col("q") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), "v"))
    out = stats.groupBy(*g, "stat").agg(*[F.max(F.when(F.col("_col") == c, F.col("v"))).alias(c) for c in cols])
    return out.select(*g, "stat", *cols)


def size_split(per_id: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Join per-question stats with table sizes; small / large."""
    j = per_id.join(sizes, "id").withColumn("total_cell", F.col("n_row") * F.col("n_col"))
    return j.withColumn("size_class", F.when(F.col("total_cell") < threshold, "small").otherwise("large"))


def token_rollup(results: DataFrame) -> DataFrame:
    """Total input / output / total tokens; missing -> 0; total
    defaults to input + output."""
    i = F.coalesce(F.col("input_token_count"), F.lit(0))
    o = F.coalesce(F.col("output_token_count"), F.lit(0))
    t = F.coalesce(F.col("total_token_count"), i + o)
    return results.agg(F.sum(i).alias("input_tokens"), F.sum(o).alias("output_tokens"),
                       F.sum(t).alias("total_tokens"), F.count(F.lit(1)).alias("n_records"))


def call_usage(calls: DataFrame, key: str = "id") -> DataFrame:
    """Per call, API usage when reported (non-zero), else the estimate;
    accumulated per question."""
    used = F.coalesce(F.nullif(F.col("api_total"), F.lit(0)), F.col("est_input") + F.col("est_output"))
    return calls.groupBy(key).agg(F.sum(used).alias("tokens"), F.count(F.lit(1)).alias("n_calls"))


def selection_breakdown(records: DataFrame) -> DataFrame:
    """Selection x answer conditional counts as long rows
    (metric, n, d, rate); rate null ('N/A') when d = 0."""
    valid = records.where(F.col("selected_is_gold").isNotNull())
    g = F.col("selected_is_gold")
    c = F.col("is_correct")
    s = valid.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(g).alias("gold"), F.count_if(~g).alias("wrong"),
        F.count_if(c).alias("correct"), F.count_if(~c).alias("incorrect"),
        F.count_if(g & c).alias("gold_correct"), F.count_if(g & ~c).alias("gold_wrong"),
        F.count_if(~g & c).alias("wrong_correct"), F.count_if(~g & ~c).alias("wrong_wrong"))
    skipped = records.where(F.col("selected_is_gold").isNull()).agg(F.count(F.lit(1)).alias("skipped"))
    pairs = [("selected_gold", "gold", "total"), ("selected_wrong", "wrong", "total"),
             ("answer_correct", "correct", "total"), ("answer_wrong", "incorrect", "total"),
             ("correct_given_gold", "gold_correct", "gold"), ("wrong_given_gold", "gold_wrong", "gold"),
             ("correct_given_wrong", "wrong_correct", "wrong"), ("wrong_given_wrong", "wrong_wrong", "wrong")]
    rows = [F.struct(F.lit(m).alias("metric"), F.col(n).alias("n"), F.col(d).alias("d"),
                     (F.col(n) / F.nullif(F.col(d), F.lit(0))).alias("rate")) for m, n, d in pairs]
    out = s.select(F.inline(F.array(*rows)))
    sk = skipped.select(F.lit("skipped").alias("metric"), F.col("skipped").alias("n"),
                        F.col("skipped").alias("d"), F.lit(None).cast("double").alias("rate"))
    return out.unionByName(sk)


def id_number(id_col: Column, prefix: str = "databench-") -> Column:
    """SC21: the integer after ``prefix``; other ids fail the query."""
    n = F.regexp_extract(id_col, f"^{prefix}(\\d+)$", 1)
    return F.when(n != "", n.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected id: "), id_col)).cast("long"))


def responses(results: DataFrame, sc_id: int = 0) -> DataFrame:
    """K3 D5 F12 SC19: one clean answer line per question in id order."""
    r = results.where(F.col("sc_id") == sc_id)
    return r.select(id_number(F.col("id")).alias("ord"), "id", A.clean_line(F.col("answer")).alias("line"))


def missing_ids(present: DataFrame, n: int | Column, ord_col: str = "ord") -> DataFrame:
    """Ids 0..n-1 that have no response; ``n`` is a number or an aggregate of ``present``."""
    if isinstance(n, int):
        full = present.sparkSession.range(0, n).withColumnRenamed("id", ord_col)
    else:
        upto = F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)
        full = present.agg(n.alias("_n")).where("_n > 0").select(F.explode(upto).alias(ord_col))
    return full.join(present.select(ord_col), ord_col, "left_anti")


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str] = ("id", "sc_id")) -> DataFrame:
    """F8: tasks without a result yet (resume)."""
    return tasks.join(done.select(*keys), list(keys), "left_anti")


def fan_out(questions: DataFrame, sc: int) -> DataFrame:
    """each question x sc_id in 0..sc-1 (bounded by ``sc``)."""
    return questions.withColumn("sc_id", F.explode(F.sequence(F.lit(0), F.lit(sc - 1))))
