"""Evidence, prompts and baseline contexts (A14-A16, SC17, SC20, J11, F9, F10,
K7, L5, D1, D4).

Texts are assembled per (question, candidate table) and then per question
with ordered aggregates; every group is bounded by candidate_k x queries x
top_k documents.  Whole-table contexts are joined chunk by chunk, and the size
guard F9 is checked on the table shape before any text is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import fill_template
from ..functions.text import token_count
from .cells import ordered_text

# Layout of an evidence section.
RULE = "=" * 72
NONE_TEXT = "(none)"
SCHEMA_QUERIES, SCHEMA_RESULTS = "Schema Retrieval Queries: ", "Schema Retrieval Results:"
CELL_QUERIES, CELL_RESULTS = "Cell Retrieval Queries: ", "Cell Retrieval Results:"


def _ordered_join(values: str, order: str, sep: str) -> Column:
    s = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(values))))
    return F.array_join(F.transform(s, lambda x: x[values]), sep)


def _placed(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with their alias df1, df2, ... by place in the list (not by
    rank, which may have gaps) and a title (the table id if there is none)."""
    order = "position" if "position" in candidates.columns else "rank"
    w = Window.partitionBy(*keys).orderBy(order, "table_id")
    title = F.coalesce(F.col("title"), F.col("table_id")) if "title" in candidates.columns else F.col("table_id")
    return (candidates.withColumn("place", F.row_number().over(w))
            .select(*keys, "place", "rank", "table_id", title.alias("title"),
                    F.concat(F.lit("df"), F.col("place").cast("string")).alias("alias")))


def evidence(union: DataFrame, queries: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per question the evidence text (sections in candidate order)
    and the candidate map text.

    union: keys..., table_id, data_type, ord, result_text (R10 output);
    queries: keys..., query_pos, query and optionally kind (column / schema or
    cell; without it every query is listed for both); candidates: keys...,
    rank, table_id and optionally position and title.
    """
    k = list(keys)
    docs = (union.groupBy(*k, "table_id", "data_type")
            .agg(_ordered_join("result_text", "ord", "\n").alias("docs")))
    kind = F.col("kind") if "kind" in queries.columns else F.lit(None).cast("string")
    q = queries.select(*k, "query_pos", "query", kind.alias("_kind"))
    schema_q = (q.where("_kind is null or _kind in ('column', 'schema')").groupBy(*k)
                .agg(_ordered_join("query", "query_pos", ", ").alias("schema_q")))
    cell_q = q.where("_kind is null or _kind = 'cell'").groupBy(*k).agg(_ordered_join("query", "query_pos", ", ").alias("cell_q"))
    sch = docs.where(F.col("data_type") == "schema").select(*k, "table_id", F.col("docs").alias("schema_docs"))
    cel = docs.where(F.col("data_type") == "cell").select(*k, "table_id", F.col("docs").alias("cell_docs"))
    c = (_placed(candidates, k).join(schema_q, k, "left").join(cell_q, k, "left")
         .join(sch, [*k, "table_id"], "left").join(cel, [*k, "table_id"], "left"))
    section = F.concat_ws(
        "\n", F.lit(RULE),
        F.concat(F.lit("Candidate "), F.col("alias"), F.lit(" | rank="), F.col("rank").cast("string"),
                 F.lit(" | table_id="), F.col("table_id")),
        F.lit(RULE),
        F.concat(F.lit(SCHEMA_QUERIES), F.coalesce("schema_q", F.lit(""))), F.lit(SCHEMA_RESULTS),
        F.coalesce(F.col("schema_docs"), F.lit(NONE_TEXT)), F.lit(""),
        F.concat(F.lit(CELL_QUERIES), F.coalesce("cell_q", F.lit(""))), F.lit(CELL_RESULTS),
        F.coalesce(F.col("cell_docs"), F.lit(NONE_TEXT)))
    line = F.concat(F.col("alias"), F.lit(": table_id="), F.col("table_id"), F.lit(" | title="), F.col("title"))
    c = c.select(*k, "place", section.alias("section"), line.alias("line"))
    return c.groupBy(*k).agg(_ordered_join("section", "place", "\n\n").alias("evidence"),
                             _ordered_join("line", "place", "\n").alias("candidate_map"),
                             F.count(F.lit(1)).alias("num_tables"))


def docs_maps(union: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alias -> retrieved documents, one map per kind per question."""
    k = list(keys)
    d = (union.join(_placed(candidates, k).select(*k, "table_id", "alias"), [*k, "table_id"])
         .groupBy(*k, "alias", "data_type")
         .agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "result_text"))),
                          lambda s: s["result_text"]).alias("docs")))
    return (d.groupBy(*k).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("data_type") == "schema", F.struct("alias", "docs"))))
        .alias("retrieved_columns"),
        F.map_from_entries(F.collect_list(F.when(F.col("data_type") == "cell", F.struct("alias", "docs"))))
        .alias("retrieved_cells")))


# Our prompt templates, keyed by (task, agent, kind).
SOLVE_TEMPLATE = (
    "Answer the question using the {num_tables} candidate tables below.\n"
    "Question: {query}\n\nCandidate tables:\n{candidate_table_map}\n\nRetrieved evidence:\n{table_evidence}\n\n"
    "Work in Thought / Action / Observation steps and finish with\n"
    'Final Answer: {{"table_source": "dfN", "answer": <value>}}')
COLUMN_TEMPLATE = "List the column names that may help answer: {query}\nReply with a JSON list."
CELL_TEMPLATE = "List the cell keywords contained in: {query}\nReply with a JSON list."
TEMPLATES = [("databench", "multi", "solve", SOLVE_TEMPLATE),
             ("databench", "multi", "column", COLUMN_TEMPLATE),
             ("databench", "multi", "cell", CELL_TEMPLATE)]


def templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "task string, agent string, kind string, template string")


def prompts(requests: DataFrame, tmpl: DataFrame, fields: Sequence[str], limit: int | None = None) -> DataFrame:
    """SC20 J11 SC17 F10: fill the template of each request's (task, agent,
    kind); an unknown pair fails; with a ``limit`` prompts of more tokens
    become the error text."""
    j = requests.join(F.broadcast(tmpl), ["task", "agent", "kind"], "left")  # a handful of rows
    t = F.coalesce(F.col("template"), F.raise_error(F.lit("unsupported task / agent pair")).cast("string"))
    filled = fill_template(t, {f: F.col(f) for f in fields})
    out = j.select("*", filled.alias("prompt")).withColumn("n_tokens", token_count(F.col("prompt")))
    if limit is not None:
        out = out.withColumn("prompt", F.when(F.col("n_tokens") > limit, F.lit("Error: the prompt exceeds the context limit."))
                             .otherwise(F.col("prompt")))
    return out.drop("template")


def markdown(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K7: a pipe table per key (header, rule, rows in row order).

    A table of more than ``cells.WHOLE_BYTES`` stays in ordered ``part`` rows
    (see `ordered_text`), the header in the first; lines end parts, so a line
    break joins them.  Any other table is part 0."""
    k = list(keys)
    hdr = (cells.select(*k, "col_id", "column_name").distinct()
           .groupBy(*k).agg(_ordered_join("column_name", "col_id", " | ").alias("_h"),
                            F.count(F.lit(1)).alias("_nc")))
    rows = (cells.withColumn("_v", F.coalesce("value", F.lit("None")))
            .groupBy(*k, "row_id").agg(F.concat(F.lit("| "), _ordered_join("_v", "col_id", " | "), F.lit(" |")).alias("_r")))
    body = ordered_text(rows, k, "row_id", "_r", "\n")
    top = F.concat(F.lit("| "), F.col("_h"), F.lit(" |\n|"), F.array_join(F.array_repeat(F.lit("---|"), F.col("_nc").cast("int")), ""))
    top = F.when(F.col("part") == 0, top)
    return hdr.join(body, k, "left").select(*k, F.concat_ws("\n", top, "text").alias("markdown"), "part")


def size_guard(shape: DataFrame, limit: int, k: int | None = None) -> DataFrame:
    """tables whose full (3*rows*cols) or sampled (3*k*cols) size is over
    ``limit``; computed from the shape only, before any text is built."""
    rows = F.col("n_rows") if k is None else F.least(F.col("n_rows"), F.lit(k))
    return shape.withColumn("too_large", 3 * rows * F.col("n_cols") > limit)


def random_rows(cells: DataFrame, k: int, seed: int, keys: Sequence[str] = ("table_id",)) -> DataFrame:
    """K rows per table chosen by a seeded hash (reproducible), in row order;
    the whole table when it has <= k rows."""
    rows = cells.select(*keys, "row_id").distinct()
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))), "row_id")
    pick = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return cells.join(pick, [*keys, "row_id"], "left_semi")


def random_context(cells: DataFrame, shape: DataFrame, k: int, seed: int, limit: int) -> DataFrame:
    """table_id, context, part (see `markdown`): k random rows of each table as a pipe table; tables whose sample would be
    too large (3 * k * columns over ``limit``) answer with an error text and are not sampled."""
    guard = shape.withColumn("too_large", F.lit(3 * k) * F.col("n_cols") > limit)
    small = guard.where(~F.col("too_large")).select("table_id")
    md = markdown(random_rows(cells.join(small, "table_id", "left_semi"), k, seed), ["table_id"])
    return guard.join(md, "table_id", "left").select("table_id", F.when(F.col("too_large"), F.lit("Error: the table is too large."))
                                                     .otherwise(F.col("markdown")).alias("context"),
                                                     F.coalesce("part", F.lit(0)).alias("part"))


def preview(cells: DataFrame, shape: DataFrame, n: int) -> DataFrame:
    """The first n/2 and last n/2 rows and columns of each table; the
    gaps are marked by an ellipsis row / column (row_id or col_id = -1)."""
    h = n // 2
    j = cells.join(shape, "table_id")
    keep_r = (F.col("row_id") < h) | (F.col("row_id") >= F.col("n_rows") - h)
    keep_c = (F.col("col_id") < h) | (F.col("col_id") >= F.col("n_cols") - h)
    kept = j.where(keep_r & keep_c).select("table_id", "row_id", "col_id", "value")
    gap_r = shape.where(F.col("n_rows") > 2 * h).select("table_id", F.lit(-1).cast("long").alias("row_id"),
                                                       F.lit(-1).cast("long").alias("col_id"),
                                                       F.lit("...").alias("value"))
    gap_c = shape.where(F.col("n_cols") > 2 * h).select("table_id", F.lit(-2).cast("long").alias("row_id"),
                                                       F.lit(-1).cast("long").alias("col_id"),
                                                       F.lit("...").alias("value"))
    return kept.withColumn("col_id", F.col("col_id").cast("long")).unionByName(gap_r).unionByName(gap_c)
