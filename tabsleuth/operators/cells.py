"""Long cell form (C0), row identity, type inference.

``cells`` is the one common schema of a heterogeneous table corpus::

    table_id STRING, row_id BIGINT, col_id INT, column_name STRING,
    dtype STRING, is_numeric BOOLEAN, value STRING, num DOUBLE

``value`` is the rendered text (functions.render), ``num`` the numeric value
of numeric columns.  Every corpus (schema, cell, row, column) is an
aggregation of it, so one job serves all tables at once.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import is_numeric_type, pandas_dtype, render

#: Bytes up to which a text that is assembled from many rows becomes one value.
WHOLE_BYTES = 1 << 26
#: Rows and bytes of a chunk of such a text; one row of more bytes is a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 1 << 24

CELL_COLUMNS = ["table_id", "row_id", "col_id", "column_name", "dtype",
                "is_numeric", "value", "num"]


def dense_row_ids(df: DataFrame, order_cols: Sequence[str | Column],
                  col: str = "row_id", num_partitions: int | None = None) -> DataFrame:
    """Attach consecutive ids 0..n-1 following a declared total order.

    ``row_number() over (order by ...)`` would pull every row into one task.
    Instead: range-partition and sort by the key (distributed), count rows per
    partition (one row per partition), turn the counts into offsets and add
    the position inside the partition.  The offsets table has one row per
    partition, so broadcasting it is bounded by the partition count.
    """
    from ..sources.store import materialize
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # The range bounds come from a sample, so a second pass could cut the
    # partitions differently.  Partition id and position are therefore
    # written once (to the shared folder) as plain columns; counts and ids
    # are computed from that written table and stay consistent even if
    # tasks are re-run after an executor loss.
    ranged = materialize(
        df.repartitionByRange(int(n), *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), 33)),
        "ranked")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(_all_rows_by("_pid")) - F.col("_n")).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(col, (F.col("_off") + F.col("_pos")).cast("long"))
            .drop("_pid", "_pos", "_off"))


def group_ordinals(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                   col: str = "ordinal", num_partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by g order by o) - 1`` without sorting a
    whole group in one task.

    Rows are range-partitioned on (g, o), so a hot group is spread over
    several partitions; the ordinal is the group's row count in earlier
    partitions plus the position inside this partition.  The offsets table
    has at most (#partitions x #groups) rows and is joined on (g, _pid).
    """
    from pyspark.sql import Window
    from ..sources.store import materialize
    g = list(group_cols)
    order = [F.col(c) for c in [*g, *order_cols]]
    n = num_partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialize(
        df.repartitionByRange(int(n), *order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), 33)),
        "ordinals")
    per = ranged.groupBy(*g, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"))
    w = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = per.select(*g, "_pid", "_p0", (F.sum("_n").over(w) - F.col("_n")).alias("_off"))
    return (ranged.join(off, [*g, "_pid"])
            .withColumn(col, (F.col("_off") + F.col("_pos") - F.col("_p0")).cast("long"))
            .drop("_pid", "_pos", "_off", "_p0"))


def _all_rows_by(c: str):
    from pyspark.sql import Window
    return Window.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def read_table(spark, path: str) -> DataFrame:
    """Parquet table scan."""
    return spark.read.parquet(path)


def to_cells(df: DataFrame, table_id: str | Column, id_col: str = "row_id",
             columns: Sequence[str] | None = None) -> DataFrame:
    """One row per cell of a wide table that carries ``id_col``.

    A narrow map (``inline`` of an array of structs): no shuffle.
    """
    cols = [c for c in (columns or df.columns) if c != id_col]
    fields = {f.name: f.dataType for f in df.schema.fields}
    tid = F.lit(table_id) if isinstance(table_id, str) else table_id
    structs = []
    for i, c in enumerate(cols):
        dt = fields[c]
        numeric = is_numeric_type(dt)
        structs.append(F.struct(
            F.lit(i).alias("col_id"),
            F.lit(c).alias("column_name"),
            F.lit(pandas_dtype(dt)).alias("dtype"),
            F.lit(numeric).alias("is_numeric"),
            render(F.col(f"`{c}`"), dt).alias("value"),
            (F.col(f"`{c}`").cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
        ))
    return (df.select(tid.alias("table_id"), F.col(id_col).cast("long").alias("row_id"),
                      F.inline(F.array(*structs))))


def cells_of(tables: Mapping[str, DataFrame], id_col: str = "row_id") -> DataFrame:
    """C0 over many tables: union of their long forms."""
    out = None
    for tid, df in tables.items():
        c = to_cells(df, tid, id_col)
        out = c if out is None else out.unionByName(c)
    return out


def rows_of(tables: Mapping[str, DataFrame], id_col: str = "row_id") -> DataFrame:
    """The cells of many tables, a row's cells as one array: table_id, row_id, cells (column_name, value, num).  No shuffle."""
    out = None
    for tid, df in tables.items():
        cells = []
        for f in (f for f in df.schema.fields if f.name != id_col):
            c = F.col(f"`{f.name}`")
            num = c.cast("double") if is_numeric_type(f.dataType) else F.lit(None).cast("double")
            cells.append(F.struct(F.lit(f.name).alias("column_name"), render(c, f.dataType).alias("value"), num.alias("num")))
        rows = df.select(F.lit(tid).alias("table_id"), F.col(id_col).cast("long").alias("row_id"), F.array(*cells).alias("cells"))
        out = rows if out is None else out.unionByName(rows)
    return out


def row_cells(cells: DataFrame) -> DataFrame:
    """`rows_of` from the long cell form: one shuffle by (table_id, row_id)."""
    return (cells.where("row_id is not null").groupBy("table_id", "row_id")
            .agg(F.collect_list(F.struct("column_name", "value", "num")).alias("cells")))


def valid_value(c: DataFrame | None = None) -> Column:
    """not null and, for numbers, not NaN."""
    return F.col("value").isNotNull() & ~(F.col("is_numeric") & F.isnan(F.coalesce(F.col("num"), F.lit(0.0))))


def drop_nulls(cells: DataFrame) -> DataFrame:
    """drop null / NaN cells."""
    return cells.where(valid_value())


def numeric_cells(cells: DataFrame) -> DataFrame:
    """cells of numeric, non-boolean columns."""
    return cells.where(F.col("is_numeric"))


# F1 -------------------------------------------------------------------------

# The accepted number and date spellings of type inference.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
#: Date spellings and their DuckDB twins; where a column satisfies several, the first one is taken.
DATE_FORMS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ssXXX", "%Y-%m-%dT%H:%M:%S%z"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "%Y-%m-%dT%H:%M:%S.%g%z"),
    ("yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g"),
    ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("M-d-yyyy", "%m-%d-%Y"),
    ("d-M-yyyy", "%d-%m-%Y"),
    ("d.M.yyyy", "%d.%m.%Y"),
    ("d MMMM yyyy", "%d %B %Y"),
    ("d MMM yyyy", "%d %b %Y"),
    ("d-MMM-yyyy", "%d-%b-%Y"),
    ("MMMM d, yyyy", "%B %d, %Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("MMMM d yyyy", "%B %d %Y"),
    ("MMM d yyyy", "%b %d %Y"),
]
_MONTHS = "January February March April May June July August September October November December".split()
#: What each part of a date form matches; values of another shape are not parsed.
_PARTS = {"yyyy": r"\d{4}", "MMMM": f"({'|'.join(_MONTHS)})", "MMM": f"({'|'.join(m[:3] for m in _MONTHS)})", "MM": r"(0[1-9]|1[0-2])", "M": r"(0?[1-9]|1[0-2])",
          "dd": r"(0[1-9]|[12]\d|3[01])", "d": r"(0?[1-9]|[12]\d|3[01])", "HH": r"([01]\d|2[0-3])", "mm": r"[0-5]\d", "ss": r"[0-5]\d", "SSS": r"\d{3}",
          "XXX": r"(Z|[+-]\d\d:\d\d)", "'T'": "T", ".": r"\."}
_SHAPES = ["^" + re.sub(r"y+|M+|d+|H+|m+|s+|S+|X+|'T'|\.", lambda m: _PARTS[m.group()], form) + "$" for form, _ in DATE_FORMS]
SQL_NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def date_mask(v: Column) -> Column:
    """A bit for each date form that a text satisfies."""
    t = F.trim(v)
    bits = [F.when(t.rlike(shape) & F.try_to_timestamp(t, F.lit(form)).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))
            for i, ((form, _), shape) in enumerate(zip(DATE_FORMS, _SHAPES))]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def parse_time(v: Column, form: Column) -> Column:
    """The time of a text by the number of its form."""
    out = F.lit(None).cast("timestamp")
    for i, (f, _) in enumerate(DATE_FORMS):
        out = F.when(form == i, F.try_to_timestamp(F.trim(v), F.lit(f))).otherwise(out)
    return out


def infer_types(cells: DataFrame) -> DataFrame:
    """per (table, column) dtype of a column of strings, whole column or nothing.

    numeric if every non-empty value is a number (int64 when all are integers
    and none is missing, else float64); else datetime if one date form fits every
    non-empty value (``date_form``, its number in ``DATE_FORMS``): a column decides
    the order of day and month, which single values may leave open; else
    object.  All-missing columns are float64.
    """
    v = F.col("value")
    missing = v.isNull() | (v == "")
    every = F.lit((1 << len(DATE_FORMS)) - 1)
    # a column's masks meet in one number
    mask = F.bit_and(F.when(missing, every).when(v.rlike(NUMBER_PATTERN), F.lit(0)).otherwise(date_mask(v)))
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    return (cells.groupBy("table_id", "col_id", "column_name")
            .agg(F.count(F.when(~missing, 1)).alias("n_present"),
                 F.count(F.lit(1)).alias("n"),
                 F.bool_and(missing | v.rlike(NUMBER_PATTERN)).alias("all_num"),
                 F.bool_and(missing | v.rlike(INTEGER_PATTERN)).alias("all_int"),
                 mask.alias("mask"))
            .withColumn("dtype", F.when(F.col("n_present") == 0, "float64")
                        .when(F.col("all_int") & (F.col("n_present") == F.col("n")), "int64")
                        .when(F.col("all_num"), "float64")
                        .when(F.col("mask") != 0, "datetime64[ns]")
                        .otherwise("object"))
            .select("table_id", "col_id", "column_name", "dtype",
                    F.when(F.col("dtype") == "datetime64[ns]", F.round(F.log2(lowest)).cast("int")).alias("date_form")))


def apply_types(cells: DataFrame, types: DataFrame, times: bool = False) -> DataFrame:
    """Typed long form: attach the inferred dtype and the numeric value; ``times``: also ``time``,
    the value of a datetime column.

    ``types`` has one row per column.  It is written first, so that its size is
    known before the cells move: a small one is broadcast and the cells of a
    large column stay where they are; else both are shuffled.
    """
    from ..sources.store import materialize
    t = materialize(types.select("table_id", "col_id", F.col("dtype").alias("_dt"), F.col("date_form").alias("_form")), "column-types")
    numeric = F.col("_dt").isin("int64", "float64")
    return (cells.drop("dtype", "is_numeric", "num")
            .join(t, ["table_id", "col_id"])
            .select("table_id", "row_id", "col_id", "column_name",
                    F.col("_dt").alias("dtype"), numeric.alias("is_numeric"),
                    F.col("value"),
                    F.when(numeric & (F.col("value") != ""), F.col("value").try_cast("double")).alias("num"),
                    *([parse_time(F.col("value"), F.col("_form")).alias("time")] if times else [])))


def stringified_cells(tables: Mapping[str, DataFrame], id_col: str = "row_id") -> DataFrame:
    """Cells of tables whose columns were all cast to text (F1 input)."""
    out = None
    for tid, df in tables.items():
        s = df.select(id_col, *[render(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                                for f in df.schema.fields if f.name != id_col])
        c = to_cells(s, tid, id_col)
        out = c if out is None else out.unionByName(c)
    return out


def write_cells(tables: Mapping[str, DataFrame], name: str = "cells", chunk: int = 32,
                id_col: str = "row_id") -> DataFrame:
    """C0 for a corpus of hundreds of tables.

    Tables are unioned ``chunk`` at a time and each chunk is written to the
    shared folder partitioned by ``table_id``; the result is one scan of all
    chunks.  Plans stay small however many tables there are, and a lookup
    of one table prunes to its partition folder."""
    from ..sources.store import materialize
    items = list(tables.items())
    parts = []
    for s in range(0, len(items), chunk):
        parts.append(materialize(cells_of(dict(items[s:s + chunk]), id_col), name, partition_by=["table_id"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered_text(rows: DataFrame, keys: Sequence[str], order: str, value: str, sep: str) -> DataFrame:
    """keys, part, text: the texts ``value`` (never null) of each key joined by ``sep`` in the order of the whole number ``order``.

    Ranges of ``order`` are joined first, so no group holds more than a chunk.
    Chunks become one text only where a key has at most ``WHOLE_BYTES``, which
    is then part 0.  A larger text stays in its chunks, one row each with
    ``part`` 0, 1, ... in order (with gaps where no row falls in a range),
    which ``sep`` would join to the whole."""
    k = list(keys)
    size = F.octet_length(F.col(value)) + len(sep)
    sizes = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in k]).agg(
        F.sum(size).alias("__bytes"), F.max(size).alias("__longest"), F.min(order).alias("__first"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in k])
    n = F.greatest(F.lit(1), F.least(F.lit(CHUNK_ROWS), F.floor(F.lit(CHUNK_BYTES) / F.col("__longest"))))

    def join_texts(text, at):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda x: x[text]), sep)

    chunks = (rows.join(sizes, same)                            # one row per text
              .withColumn("__chunk", F.floor((F.col(order) - F.col("__first")) / n))
              .groupBy(*k, "__bytes", "__chunk").agg(join_texts(value, order).alias("__text")))
    part = F.when(F.col("__bytes") > WHOLE_BYTES, F.col("__chunk")).otherwise(F.lit(0)).cast("long")
    return chunks.withColumn("part", part).groupBy(*k, "part").agg(join_texts("__text", "__chunk").alias("text"))
