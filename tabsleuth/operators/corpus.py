"""Retrieval corpora built by aggregation.

Every builder takes the long ``cells`` form of many tables and returns
``docs(table_id, doc_ord, page_content[, result_text, row_id, col_id])`` for
all tables at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import json_string
from .cells import group_ordinals, ordered_text
from .profile import numeric_json, numeric_profile, top_values, value_counts


def _cell_json() -> Column:
    return F.concat(F.lit('{"column_name": '), json_string(F.col("column_name")),
                    F.lit(', "cell_value": '), json_string(F.col("value")), F.lit("}"))


def cell_docs(cells: DataFrame, budget: int | None = None) -> DataFrame:
    """Cell documents of every table, all of them or under a cell budget B.

    * one document per numeric column with its min / max, always kept, first;
    * categorical documents ``{"column_name", "cell_value"}``: the B most
      frequent values of each column compete, then the table keeps the
      ``max(0, B - #numeric docs)`` most frequent of those (count desc, column
      position, value).

    The per-column window prunes before the per-table window, so the
    second window sees at most B rows per column.  Without a budget every
    distinct value is a document, and documents are numbered in the same order
    by distributed ordinals.
    """
    num = numeric_profile(cells)
    num = num.select("table_id", "col_id", numeric_json(num).alias("page_content"))
    w_num = Window.partitionBy("table_id").orderBy("col_id")
    num = num.withColumn("doc_ord", (F.row_number().over(w_num) - 1).cast("long"))
    n_num = num.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_numeric"))

    if budget is None:
        ranked = group_ordinals(value_counts(cells).withColumn("_desc", -F.col("cnt")), ["table_id"], ["_desc", "col_id", "value"], col="trank")
        cat = (ranked.join(n_num, "table_id", "left")
               .select("table_id", "col_id", _cell_json().alias("page_content"),
                       (F.coalesce("n_numeric", F.lit(0)) + F.col("trank")).cast("long").alias("doc_ord")))
        return num.select("table_id", "doc_ord", "page_content").unionByName(cat.select("table_id", "doc_ord", "page_content"))

    per_col = top_values(value_counts(cells), budget)
    w_tab = Window.partitionBy("table_id").orderBy(F.desc("cnt"), F.asc("col_id"), F.asc("vrank"))
    cat = (per_col.withColumn("trank", F.row_number().over(w_tab))
           .where(F.col("trank") <= budget)
           .join(n_num, "table_id", "left")
           .withColumn("n_numeric", F.coalesce("n_numeric", F.lit(0)))
           .where(F.col("trank") <= F.greatest(F.lit(0), F.lit(budget) - F.col("n_numeric")))
           .select("table_id", "col_id", _cell_json().alias("page_content"),
                   (F.col("n_numeric") + F.col("trank") - 1).cast("long").alias("doc_ord")))
    return num.select("table_id", "doc_ord", "page_content").unionByName(
        cat.select("table_id", "doc_ord", "page_content"))


def head_rows(n_cols: Column, budget: int) -> Column:
    """Number of leading rows sampled for row / column corpora."""
    return F.greatest(F.lit(1), F.floor(F.floor(F.lit(budget) / 2) / n_cols))


def budgeted_cells(cells: DataFrame, budget: int) -> DataFrame:
    """Cells of the first ``max(1, B//2//ncols)`` rows of each table."""
    ncols = cells.groupBy("table_id").agg(F.max("col_id").alias("_mc"))
    return (cells.join(ncols, "table_id")
            .where(F.col("row_id") < head_rows(F.col("_mc") + 1, budget))
            .drop("_mc"))


def _placeholder() -> Column:
    """Text of a missing cell in row / column documents."""
    return (F.when(F.col("dtype").startswith("float") | F.col("dtype").startswith("int"), "nan")
            .when(F.col("dtype").startswith("datetime"), "NaT").otherwise("None"))


def row_docs_wide(df: DataFrame, table_id: str, budget: int | None = None) -> DataFrame:
    """C7 straight from a wide table: a narrow map, no shuffle."""
    from ..functions.render import is_numeric_type, render, TIMESTAMPS
    cols = [f for f in df.schema.fields if f.name != "row_id"]
    if budget is not None:
        df = df.where(F.col("row_id") < max(1, budget // 2 // len(cols)))

    def ph(f):
        if is_numeric_type(f.dataType):
            return "nan"
        if isinstance(f.dataType, TIMESTAMPS):
            return "NaT"
        return "None"
    parts = [F.coalesce(render(F.col(f"`{f.name}`"), f.dataType), F.lit(ph(f))) for f in cols]
    return df.select(F.lit(table_id).alias("table_id"), F.col("row_id").alias("doc_ord"),
                     F.concat_ws("|", *parts).alias("page_content"), "row_id")


def column_docs(cells: DataFrame) -> DataFrame:
    """All values of a column joined by ``|`` in row order, doc_ord = col_id.

    A column of more than ``cells.WHOLE_BYTES`` stays in ordered ``part`` rows
    (see `ordered_text`); any other is part 0."""
    v = cells.withColumn("_v", F.coalesce("value", _placeholder()))
    docs = ordered_text(v, ["table_id", "col_id"], "row_id", "_v", "|").withColumnRenamed("text", "page_content")
    return docs.select("table_id", F.col("col_id").alias("doc_ord"), "page_content", "col_id", "part")
