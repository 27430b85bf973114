"""Table-question programs (L4).

Model-written code is not run.  A program is a typed row -- (program_id, table_id, filter column,
filter value, aggregate, target column) -- and all programs are evaluated
at once: the cells of a row are one array, the rows meet the programs in one equi-join on
(table, column, value), the target cell is taken from the array, and one grouped
aggregation by program follows; count counts values, not nulls.  No table is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import number_print
from ..sources.store import materialize
from .cells import row_cells

AGGS = ("count", "sum", "mean", "min", "max", "nunique", "mode", "any", "all", "argmax", "argmin", "top")
COMPARISONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Defaults of the optional columns: how the filter compares (=, !=, <, <=, >, >=, contains), the column
#: that argmax / argmin / top order by, and how many values top lists.
OPTIONAL = {"filter_op": ("=", "string"), "by_col": (None, "string"), "n": (1, "long")}


def _probed(programs: DataFrame, rows: DataFrame) -> DataFrame:
    """Program columns, row_id and ``cells`` (those that the table's programs name) of the rows that each program's filter keeps.

    A row is looked up as a whole, by (column, value) for equalities and by column for other
    comparisons, and only for what some program of its table asks: one pass over the rows and one
    equi-join with the programs.  A row's cells travel with it, so no cells are joined by row."""
    way = F.when(F.col("filter_col").isNull(), 0).when(F.col("filter_op") == "=", 1).otherwise(2)
    asked = programs.withColumn("_way", way)
    # one row for each table that is named
    named = asked.groupBy("table_id").agg(
        F.bool_or(F.col("_way") == 0).alias("_whole"), *[F.collect_set(F.when(F.col("_way") == w, F.col("filter_col"))).alias(n) for n, w in (("_equal", 1), ("_other", 2))],
        F.array_union(F.collect_set("target_col"), F.collect_set("by_col")).alias("_read"))
    keep = [c for c in programs.columns if c != "table_id"]
    asked = asked.select("table_id", *keep, "_way", F.when(F.col("_way") == 0, "").otherwise(F.col("filter_col")).alias("_col"),
                         F.when(F.col("_way") == 1, F.col("filter_value")).otherwise("").alias("_value"))

    def probe(w, c=None):
        none = F.lit(None)
        return F.struct(F.lit(w).alias("_way"), (c["column_name"] if w else F.lit("")).alias("_col"), (c["value"] if w == 1 else F.lit("")).alias("_value"),
                        (c["value"] if w == 2 else none).cast("string").alias("_v"), (c["num"] if w == 2 else none).cast("double").alias("_x"))

    def among(names):
        return F.filter("cells", lambda c: F.array_contains(names, c["column_name"]))
    whole = F.filter(F.array(probe(0)), lambda p: F.col("_whole"))
    probes = F.concat(whole, F.transform(among("_equal"), lambda c: probe(1, c)), F.transform(among("_other"), lambda c: probe(2, c)))
    looked = rows.join(F.broadcast(named), "table_id").select("table_id", "row_id", among("_read").alias("cells"), F.inline(probes))
    got = looked.join(asked, ["table_id", "_way", "_col", "_value"])
    # Other comparisons read the filter column once for each program.
    bound = F.col("filter_value").try_cast("double")
    test = F.when(F.col("_way") < 2, True).when(F.col("filter_op") == "!=", F.col("_v") != F.col("filter_value")).when(
        F.col("filter_op") == "contains", F.contains(F.lower("_v"), F.lower("filter_value")))
    for op, compare in COMPARISONS.items():
        test = test.when(F.col("filter_op") == op, compare(F.col("_x"), bound))
    test = test.otherwise(F.raise_error(F.concat(F.lit("unknown comparison: "), F.col("filter_op"))).cast("boolean"))
    return got.where(test).select("row_id", "cells", *keep)


def _cell(column):
    """The row's cell (column_name, value, num) of the column that ``column`` names."""
    return F.inline(F.filter("cells", lambda c: c["column_name"] == F.col(column)))


def _by_order(programs: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """(program_id, best): target values in the order of another column, the first ``n`` (at most ``most``) joined by ' | '.

    Rows without a number in that column do not take part; ties go to the earlier row."""
    by = _probed(programs, rows).select("row_id", "cells", "program_id", "agg", "n", "target_col", _cell("by_col")).where("num is not null and not isnan(num)")
    order = F.when(F.col("agg") == "argmin", F.col("num")).otherwise(-F.col("num")).alias("_order")
    by = by.select("row_id", "cells", "program_id", "agg", "n", "target_col", order)
    by = by.select("row_id", "program_id", "agg", "n", "_order", _cell("target_col")).select("row_id", "program_id", "agg", "n", "_order", F.col("value").alias("_t"))
    w = Window.partitionBy("program_id").orderBy("_order", "row_id")
    # the constant bound lets every task pass on only its own first rows
    top = by.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    top = top.where(F.col("_r") <= F.when(F.col("agg") == "top", F.col("n")).otherwise(1))
    return top.groupBy("program_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda s: s["_t"]), " | ").alias("best"))


def evaluate(programs: DataFrame, cells: DataFrame) -> DataFrame:
    """programs(program_id, table_id, filter_col, filter_value, agg, target_col and the
    columns of ``OPTIONAL``) -> (program_id, agg, answer text, n_rows).

    ``cells`` is the long cell form or its rows (`cells.rows_of`, which need no shuffle)."""
    # An unknown aggregate fails; nothing is answered for it.
    programs = programs.withColumn("agg", F.when(F.col("agg").isin(*AGGS), F.col("agg")).otherwise(
        F.raise_error(F.concat(F.lit("unknown aggregate: "), F.coalesce("agg", F.lit("null")))).cast("string")))
    for name, (value, kind) in OPTIONAL.items():
        default = F.lit(value).cast(kind)
        programs = programs.withColumn(name, F.coalesce(F.col(name), default) if name in programs.columns else default)
    # programs are few beside cells: written once, so that their size is known where they meet the rows
    programs = materialize(programs, "programs")
    kinds = {r["agg"]: r["n"] for r in programs.groupBy("agg").agg(F.max("n").alias("n")).collect()}       # at most a row for each aggregate
    rows = cells if "cells" in cells.columns else row_cells(cells)

    def values(some):
        return _probed(some, rows).select("program_id", "agg", _cell("target_col")).drop("column_name")
    # mode: a partial count by (program, value), then the most frequent (ties: smallest value)
    mode = (values(programs.where("agg = 'mode'")).where("value is not null").groupBy("program_id", "value").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy("program_id").agg(F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("mode_value")))
    agg = (values(programs).groupBy("program_id", "agg")
           .agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("_present"),
                # exact decimal sums: the answer does not depend on summation order
                F.sum(F.col("num").cast("decimal(38,10)")).cast("double").alias("_sum"),
                (F.sum(F.col("num").cast("decimal(38,10)")).cast("double") / F.count("num")).alias("_mean"),
                F.min("num").alias("_min"), F.max("num").alias("_max"),
                F.count_distinct(F.when(F.col("agg") == "nunique", F.col("value"))).alias("_nunique"),
                F.bool_or(F.col("num") != 0).alias("_any"), F.bool_and(F.col("num") != 0).alias("_all")))
    a = F.col("agg")
    num = lambda x: number_print(F.round(x, 6))
    # parts that no program asks for are left out of the plan
    nothing = F.lit(None).cast("string")
    agg = agg.join(mode, "program_id", "left") if "mode" in kinds else agg.withColumn("mode_value", nothing)
    ordered = [k for k in ("argmax", "argmin", "top") if k in kinds]
    if ordered:
        most = max([1, *[kinds[k] for k in ordered if k == "top"]])
        agg = agg.join(_by_order(programs.where(F.col("agg").isin(ordered)), rows, most), "program_id", "left")
    else:
        agg = agg.withColumn("best", nothing)
    answer = (F.when(a == "count", F.col("_present").cast("string"))
              .when(a == "sum", num(F.col("_sum"))).when(a == "mean", num(F.col("_mean")))
              .when(a == "min", num(F.col("_min"))).when(a == "max", num(F.col("_max")))
              .when(a == "nunique", F.col("_nunique").cast("string"))
              .when(a == "mode", F.col("mode_value")).when(a.isin("argmax", "argmin", "top"), F.col("best"))
              .when(a == "any", F.when(F.col("_any"), "True").otherwise("False"))
              .when(a == "all", F.when(F.col("_all"), "True").otherwise("False")))
    # written once: the programs without rows are found by it
    out = materialize(agg.select("program_id", "agg", answer.alias("answer"), "n_rows"), "program-answers")
    # programs that matched no row answer 0 / nothing
    empty = programs.join(out.select("program_id"), "program_id", "left_anti").select(
        "program_id", "agg", F.when(F.col("agg").isin("count", "nunique"), F.lit("0")).alias("answer"),
        F.lit(0).cast("long").alias("n_rows"))
    return out.unionByName(empty)
