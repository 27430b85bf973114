"""Schema profiles (C1-C3), column info (F18) and table shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import json_string, render_double
from .cells import valid_value

INT_DTYPES = ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


def number_text(x: Column, dtype: Column) -> Column:
    """JSON text of a profile number: integer columns print as integers."""
    return (F.when(x.isNull(), F.lit("null"))
            .when(dtype.isin(*INT_DTYPES), x.cast("long").cast("string"))
            .otherwise(render_double(x)))


def numeric_profile(cells: DataFrame) -> DataFrame:
    """{name, dtype, min, max} per numeric column; null min/max when empty."""
    ok = valid_value()
    return (cells.where(F.col("is_numeric"))
            .groupBy("table_id", "col_id", "column_name", "dtype")
            .agg(F.min(F.when(ok, F.col("num"))).alias("min_value"),
                 F.max(F.when(ok, F.col("num"))).alias("max_value")))


def numeric_json(p: DataFrame) -> Column:
    return F.concat(
        F.lit('{"column_name": '), json_string(F.col("column_name")),
        F.lit(', "dtype": '), json_string(F.col("dtype")),
        F.lit(', "min": '), number_text(F.col("min_value"), F.col("dtype")),
        F.lit(', "max": '), number_text(F.col("max_value"), F.col("dtype")),
        F.lit("}"))


def value_counts(cells: DataFrame) -> DataFrame:
    """Frequency of each text value of each non-numeric column (nulls dropped).

    The count is a map-side-combined aggregation keyed by the value itself,
    so a hot column is spread over many tasks.
    """
    return (cells.where(~F.col("is_numeric") & valid_value())
            .groupBy("table_id", "col_id", "column_name", "dtype", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """D3: the n most frequent values per column (count desc, value asc).

    ``row_number() <= n`` gets a partial per-partition limit before the
    shuffle (WindowGroupLimit), so no task sorts a whole column.
    """
    w = Window.partitionBy("table_id", "col_id").orderBy(F.desc("cnt"), F.asc("value"))
    return counts.withColumn("vrank", F.row_number().over(w)).where(F.col("vrank") <= n)


def categorical_profile(cells: DataFrame, n: int = 3) -> DataFrame:
    """{name, dtype, top-n values by frequency} per non-numeric column."""
    top = top_values(value_counts(cells), n)
    cats = (top.groupBy("table_id", "col_id", "column_name", "dtype")
            .agg(F.sort_array(F.collect_list(F.struct("vrank", "value"))).alias("_ex"))
            .select("table_id", "col_id", "column_name", "dtype",
                    F.transform("_ex", lambda s: s["value"]).alias("cell_examples")))
    # columns whose values are all null still get a profile with no examples
    cols = (cells.where(~F.col("is_numeric"))
            .select("table_id", "col_id", "column_name", "dtype").distinct())
    return (cols.join(cats, ["table_id", "col_id", "column_name", "dtype"], "left")
            .withColumn("cell_examples", F.coalesce("cell_examples", F.array().cast("array<string>"))))


def categorical_json(p: DataFrame) -> Column:
    return F.concat(
        F.lit('{"column_name": '), json_string(F.col("column_name")),
        F.lit(', "dtype": '), json_string(F.col("dtype")),
        F.lit(', "cell_examples": ['),
        F.array_join(F.transform("cell_examples", json_string), ", "),
        F.lit("]}"))


def schema_docs(cells: DataFrame, n_examples: int = 3) -> DataFrame:
    """One schema document per column.

    page_content = column name, result_text = JSON profile; doc_ord = col_id.
    """
    num = numeric_profile(cells)
    num = num.select("table_id", "col_id", "column_name", numeric_json(num).alias("result_text"))
    cat = categorical_profile(cells, n_examples)
    cat = cat.select("table_id", "col_id", "column_name", categorical_json(cat).alias("result_text"))
    return (num.unionByName(cat)
            .select("table_id", F.col("col_id").alias("doc_ord"),
                    F.col("column_name").alias("page_content"), "result_text"))


def column_info(cells: DataFrame) -> DataFrame:
    """dtype and non-null count per column (df.info)."""
    return (cells.groupBy("table_id", "col_id", "column_name", "dtype")
            .agg(F.count(F.when(valid_value(), 1)).alias("non_null")))


def table_shape(cells: DataFrame) -> DataFrame:
    """n_rows, n_cols per table: every row has a cell of every column, so rows are the cells of one column."""
    columns = cells.groupBy("table_id", "col_id").agg(F.count(F.lit(1)).alias("n"))
    return columns.groupBy("table_id").agg(F.max("n").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"))


def table_shape_wide(tables: dict[str, DataFrame]) -> DataFrame:
    """A13 from the wide tables: a count per table, no long form needed."""
    out = None
    for tid, df in tables.items():
        ncols = len([c for c in df.columns if c != "row_id"])
        s = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(tid).alias("table_id"), "n_rows", F.lit(ncols).cast("long").alias("n_cols"))
        out = s if out is None else out.unionByName(s)
    return out
