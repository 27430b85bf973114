"""Registered queries: long form, typing, profiles and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.render import sql_json_string as J
from ..operators import cells as C
from ..operators import corpus as K
from ..operators import profile as P
from . import fixtures as X
from .registry import register

INTS = "('int8','int16','int32','int64','uint8','uint16','uint32','uint64')"


def sql_numtext(x: str) -> str:
    from ..functions.render import SQL_RENDER_DOUBLE
    return (f"CASE WHEN {x} IS NULL THEN 'null' WHEN dtype IN {INTS} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE {SQL_RENDER_DOUBLE.format(x=x)} END")


def sql_numeric_profile(cells: str) -> str:
    return (f"(SELECT table_id, col_id, column_name, dtype, "
            f"min(CASE WHEN value IS NOT NULL AND NOT isnan(num) THEN num END) AS min_value, "
            f"max(CASE WHEN value IS NOT NULL AND NOT isnan(num) THEN num END) AS max_value "
            f"FROM {cells} WHERE is_numeric GROUP BY table_id, col_id, column_name, dtype)")


def sql_numeric_json() -> str:
    return (f"'{{\"column_name\": ' || {J('column_name')} || ', \"dtype\": ' || {J('dtype')} || "
            f"', \"min\": ' || {sql_numtext('min_value')} || ', \"max\": ' || {sql_numtext('max_value')} || '}}'")


def sql_value_counts(cells: str) -> str:
    return (f"(SELECT table_id, col_id, column_name, dtype, value, count(*) AS cnt FROM {cells} "
            f"WHERE NOT is_numeric AND value IS NOT NULL GROUP BY table_id, col_id, column_name, dtype, value)")


def sql_top_values(cells: str, n: int) -> str:
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, col_id "
            f"ORDER BY cnt DESC, value ASC) AS vrank FROM {sql_value_counts(cells)}) WHERE vrank <= {n})")


def sql_categorical_profile(cells: str, n: int = 3) -> str:
    return (f"(SELECT table_id, col_id, column_name, dtype, list(value ORDER BY vrank) AS ex "
            f"FROM {sql_top_values(cells, n)} GROUP BY table_id, col_id, column_name, dtype)")


def sql_schema_docs(cells: str) -> str:
    cat_json = (f"'{{\"column_name\": ' || {J('column_name')} || ', \"dtype\": ' || {J('dtype')} || "
                f"', \"cell_examples\": [' || array_to_string(list_transform(ex, lambda x: {J('x')}), ', ') || ']}}'")
    return (f"(SELECT table_id, col_id AS doc_ord, column_name AS page_content, {sql_numeric_json()} AS result_text "
            f"FROM {sql_numeric_profile(cells)} UNION ALL "
            f"SELECT table_id, col_id AS doc_ord, column_name AS page_content, {cat_json} AS result_text "
            f"FROM {sql_categorical_profile(cells)})")


def sql_cell_docs(cells: str, budget: int | None = None) -> str:
    num = (f"(SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY col_id) - 1 AS BIGINT) AS doc_ord, "
           f"{sql_numeric_json()} AS page_content FROM {sql_numeric_profile(cells)})")
    cat = (f"(SELECT t.*, coalesce(nn.n_numeric, 0) AS n_numeric FROM (SELECT *, row_number() OVER "
           f"(PARTITION BY table_id ORDER BY cnt DESC, col_id ASC, vrank ASC) AS trank "
           f"FROM {sql_top_values(cells, budget if budget is not None else 1 << 62)}) t LEFT JOIN (SELECT table_id, count(*) AS n_numeric "
           f"FROM {sql_numeric_profile(cells)} GROUP BY table_id) nn USING (table_id))")
    limit = "true" if budget is None else f"trank <= {budget} AND trank <= greatest(0, {budget} - n_numeric)"
    return (f"(SELECT table_id, doc_ord, page_content FROM {num} UNION ALL "
            f"SELECT table_id, CAST(n_numeric + trank - 1 AS BIGINT) AS doc_ord, "
            f"'{{\"column_name\": ' || {J('column_name')} || ', \"cell_value\": ' || {J('value')} || '}}' AS page_content "
            f"FROM {cat} WHERE {limit})")


def sql_row_docs(name: str, budget: int | None) -> str:
    cols = X.STAR_SCHEMAS[name]
    ph = {"int": "'nan'", "bigint": "'nan'", "double": "'nan'", "timestamp": "'NaT'", "string": "'None'"}
    parts = " || '|' || ".join(f"coalesce({c}, {ph[t]})" for c, t in cols)
    where = f"WHERE row_id < {max(1, budget // 2 // len(cols))}" if budget else ""
    return (f"(SELECT '{name}' AS table_id, row_id AS doc_ord, {parts} AS page_content, row_id "
            f"FROM {X.sql_wide_rendered(name)} {where})")


def sql_budgeted_cells(cells: str, budget: int) -> str:
    return (f"(SELECT c.* FROM {cells} c JOIN (SELECT table_id, max(col_id) AS mc FROM {cells} GROUP BY table_id) m "
            f"USING (table_id) WHERE row_id < greatest(1, floor(floor({budget} / 2) / (mc + 1))))")


def sql_column_docs(cells: str) -> str:
    return (f"(SELECT table_id, col_id AS doc_ord, string_agg(coalesce(value, CASE WHEN dtype LIKE 'float%' "
            f"OR dtype LIKE 'int%' THEN 'nan' WHEN dtype LIKE 'datetime%' THEN 'NaT' ELSE 'None' END), '|' "
            f"ORDER BY row_id) AS page_content, col_id FROM {cells} GROUP BY table_id, col_id)")


# --- registered ---------------------------------------------------------------------

@register("long_cells", f"SELECT * FROM {X.sql_cells(['nation', 'region'])}")
def long_cells(spark, sf_dir):
    """Long cell form of nation and region."""
    return C.cells_of(X.star_tables(spark, sf_dir, ["nation", "region"]))


@register("infer_types",
          "SELECT table_id, col_id, column_name, CASE WHEN n_present = 0 THEN 'float64' "
          "WHEN all_int AND n_present = n THEN 'int64' WHEN all_num THEN 'float64' "
          "WHEN all_ts THEN 'datetime64[ns]' ELSE 'object' END AS dtype, "
          "CAST(n_present AS BIGINT) AS n_present FROM ("
          "SELECT table_id, col_id, column_name, count(CASE WHEN value IS NOT NULL AND value <> '' THEN 1 END) AS n_present, "
          "count(*) AS n, "
          f"bool_and(value IS NULL OR value = '' OR regexp_matches(value, '{C.SQL_NUMBER_PATTERN}')) AS all_num, "
          f"bool_and(value IS NULL OR value = '' OR regexp_matches(value, '{C.INTEGER_PATTERN}')) AS all_int, "
          + " OR ".join(f"bool_and(value IS NULL OR value = '' OR try_strptime(value, '{f}') IS NOT NULL)" for _, f in C.DATE_FORMS)
          + f" AS all_ts FROM {X.sql_cells(['part', 'orders'], stringify=True)} "
          "GROUP BY table_id, col_id, column_name)")
def infer_types(spark, sf_dir):
    """F1 F2: infer column types of part and orders with every column cast to text."""
    raw = C.stringified_cells(X.star_tables(spark, sf_dir, ["part", "orders"]))
    types = C.infer_types(raw)
    typed = C.apply_types(raw, types)
    present = (typed.groupBy("table_id", "col_id")
               .agg(F.count(F.when(F.col("value").isNotNull() & (F.col("value") != ""), 1)).alias("n_present")))
    return types.drop("date_form").join(present, ["table_id", "col_id"])


#: Spellings of an order's date, by column: Spark pattern (null: see the query) and its DuckDB text.
_SPELLINGS = [("iso_zone", "yyyy-MM-dd'T'HH:mm:ss'Z'"), ("long", "d MMMM yyyy"), ("day_first", "dd/MM/yyyy"), ("month_first", "M/d/yyyy"),
              ("open_order", "MM/dd/yyyy"), ("comma", "MMM d, yyyy"), ("dots", "d.M.yyyy"), ("mixed", "yyyy-MM-dd"), ("gaps", "yyyy/MM/dd")]


@register("date_columns",
          "WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d, day(o_orderdate) <= 12 AS low FROM orders) " + " UNION ALL ".join(
              f"SELECT '{n}' AS column_name, '{'object' if n == 'mixed' else 'datetime64[ns]'}' AS dtype, CAST(count(*) AS BIGINT) AS n, "
              + ("CAST(NULL AS BIGINT) AS seconds" if n == "mixed" else
                 f"CAST(sum(epoch({'CASE WHEN o_orderkey % 3 > 0 THEN d END' if n == 'gaps' else 'd'})) AS BIGINT) AS seconds")
              + f" FROM o{' WHERE low' if n == 'open_order' else ''}" for n, _ in _SPELLINGS))
def date_columns(spark, sf_dir):
    """nine columns of order dates in other spellings, their inferred types and the sum of their times."""
    day = F.date_trunc("day", F.col("o_orderdate"))
    o = X.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), day.alias("d"))
    values = []
    for i, (n, pattern) in enumerate(_SPELLINGS):
        v = F.date_format("d", pattern)
        if n == "mixed":
            v = F.when(F.col("row_id") % 2 == 0, F.date_format("d", "d MMMM yyyy")).otherwise(v)
        if n == "gaps":
            v = F.when(F.col("row_id") % 3 > 0, v).otherwise(F.when(F.col("row_id") % 2 == 0, F.lit("")))
        keep = (F.dayofmonth("d") <= 12) if n == "open_order" else F.lit(True)
        values.append(F.struct(F.lit(i).alias("col_id"), F.lit(n).alias("column_name"), v.alias("value"), keep.alias("keep")))
    cells = o.select(F.lit("dates").alias("table_id"), "row_id", F.inline(F.array(*values))).where("keep").drop("keep")
    typed = C.apply_types(cells, C.infer_types(cells), times=True)
    return typed.groupBy("column_name", "dtype").agg(F.count(F.lit(1)).alias("n"), F.sum(F.unix_seconds("time")).alias("seconds"))


@register("schema_profile_numeric",
          f"SELECT * FROM {sql_numeric_profile(X.sql_cells(['part', 'customer', 'supplier']))}")
def schema_profile_numeric(spark, sf_dir):
    """Min / max of every numeric column."""
    return P.numeric_profile(C.cells_of(X.star_tables(spark, sf_dir, ["part", "customer", "supplier"])))


@register("schema_profile_categorical",
          "SELECT table_id, col_id, column_name, dtype, array_to_string(ex, ' | ') AS cell_examples "
          f"FROM {sql_categorical_profile(X.sql_cells(['part', 'orders', 'customer']))}")
def schema_profile_categorical(spark, sf_dir):
    """Three most frequent values of every categorical column."""
    p = P.categorical_profile(C.cells_of(X.star_tables(spark, sf_dir, ["part", "orders", "customer"])))
    return p.select("table_id", "col_id", "column_name", "dtype",
                    F.array_join("cell_examples", " | ").alias("cell_examples"))


@register("schema_docs", f"SELECT * FROM {sql_schema_docs(X.sql_cells(['part', 'orders', 'customer']))}")
def schema_docs(spark, sf_dir):
    """Schema documents (column name + JSON profile)."""
    return P.schema_docs(C.cells_of(X.star_tables(spark, sf_dir, ["part", "orders", "customer"])))


@register("column_info",
          "SELECT i.*, s.n_rows, s.n_cols FROM (SELECT table_id, col_id, column_name, dtype, "
          "count(CASE WHEN value IS NOT NULL AND NOT (is_numeric AND isnan(coalesce(num, 0))) THEN 1 END) AS non_null "
          f"FROM {X.sql_cells(X.ALL_STAR)} GROUP BY ALL) i JOIN (SELECT table_id, count(DISTINCT row_id) AS n_rows, "
          f"count(DISTINCT col_id) AS n_cols FROM {X.sql_cells(X.ALL_STAR)} GROUP BY table_id) s USING (table_id)")
def column_info(spark, sf_dir):
    """Dtype and non-null count per column, table shape."""
    cells = C.cells_of(X.star_tables(spark, sf_dir, X.ALL_STAR))
    return P.column_info(cells).join(P.table_shape(cells), "table_id")


@register("cell_corpus_budget", f"SELECT * FROM {sql_cell_docs(X.sql_cells(['part', 'customer']), 20)}")
def cell_corpus_budget(spark, sf_dir):
    """Cell documents under a budget of 20 per table."""
    return K.cell_docs(C.cells_of(X.star_tables(spark, sf_dir, ["part", "customer"])), 20)


@register("row_corpus",
          f"SELECT table_id, doc_ord, page_content FROM {sql_row_docs('nation', 1000)} "
          f"UNION ALL SELECT table_id, doc_ord, page_content FROM {sql_row_docs('part', 1000)}")
def row_corpus(spark, sf_dir):
    """Row documents of the leading rows under budget 1000."""
    t = X.star_tables(spark, sf_dir, ["nation", "part"])
    return (K.row_docs_wide(t["nation"], "nation", 1000)
            .unionByName(K.row_docs_wide(t["part"], "part", 1000))
            .drop("row_id"))


@register("column_corpus",
          f"SELECT table_id, doc_ord, page_content, CAST(0 AS BIGINT) AS part FROM "
          f"{sql_column_docs(sql_budgeted_cells(X.sql_cells(['nation', 'part']), 1000))}")
def column_corpus(spark, sf_dir):
    """Column documents over the leading rows under budget 1000."""
    cells = C.cells_of(X.star_tables(spark, sf_dir, ["nation", "part"]))
    return K.column_docs(K.budgeted_cells(cells, 1000)).drop("col_id")


@register("cell_corpus", f"SELECT * FROM {sql_cell_docs(X.sql_cells(['part', 'customer', 'orders']))}")
def cell_corpus(spark, sf_dir):
    """Cell documents of whole tables, every distinct value."""
    return K.cell_docs(C.cells_of(X.star_tables(spark, sf_dir, ["part", "customer", "orders"])))


@register("row_corpus_whole",
          f"SELECT table_id, doc_ord, page_content FROM {sql_row_docs('part', None)} "
          f"UNION ALL SELECT table_id, doc_ord, page_content FROM {sql_row_docs('orders', None)}")
def row_corpus_whole(spark, sf_dir):
    """A document of every row."""
    t = X.star_tables(spark, sf_dir, ["part", "orders"])
    return (K.row_docs_wide(t["part"], "part").unionByName(K.row_docs_wide(t["orders"], "orders")).drop("row_id"))


@register("column_corpus_whole",
          f"SELECT table_id, doc_ord, page_content, CAST(0 AS BIGINT) AS part FROM {sql_column_docs(X.sql_cells(['nation', 'part', 'supplier']))}")
def column_corpus_whole(spark, sf_dir):
    """A document of every whole column."""
    return K.column_docs(C.cells_of(X.star_tables(spark, sf_dir, ["nation", "part", "supplier"]))).drop("col_id")
