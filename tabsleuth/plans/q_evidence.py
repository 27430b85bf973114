"""Registered queries: evidence, prompts and baseline contexts
(A14-A16, SC17, SC20, J11, F9, F10, K7, L5, D1, D4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import evidence as EV
from ..operators import expand as XP
from ..operators import profile as P
from ..operators import tokens as TK
from ..operators import retrieve as R
from . import fixtures as X
from .flagship import TOP_K, hits, plan, sql_plan_ctes
from .registry import register

SQL_UNION = """, u AS (SELECT question_id, table_id, data_type, result_text, row_number() OVER
  (PARTITION BY question_id, table_id, data_type ORDER BY min_pos, min_rank) AS ord FROM (
  SELECT question_id, table_id, data_type, result_text, arg_min(query_pos, struct_pack(p := query_pos, r := rank)) AS min_pos,
         arg_min(rank, struct_pack(p := query_pos, r := rank)) AS min_rank FROM hits GROUP BY ALL)),
dl AS (SELECT question_id, table_id, data_type, string_agg(result_text, chr(10) ORDER BY ord) AS docs FROM u GROUP BY ALL),
ql AS (SELECT question_id, string_agg(query, ', ' ORDER BY query_pos) AS qlist FROM qs GROUP BY question_id),
sec AS (SELECT c.question_id, c.rank, c.table_id, repeat('=', 72) || chr(10) || 'Candidate df' || CAST(c.rank AS VARCHAR)
  || ' | rank=' || CAST(c.rank AS VARCHAR) || ' | table_id=' || c.table_id || chr(10) || repeat('=', 72) || chr(10)
  || 'Schema Retrieval Queries: ' || coalesce(ql.qlist, '') || chr(10) || 'Schema Retrieval Results:' || chr(10)
  || coalesce(s.docs, '(none)') || chr(10) || chr(10) || 'Cell Retrieval Queries: ' || coalesce(ql.qlist, '') || chr(10)
  || 'Cell Retrieval Results:' || chr(10) || coalesce(e.docs, '(none)') AS section,
  'df' || CAST(c.rank AS VARCHAR) || ': table_id=' || c.table_id || ' | title=' || c.table_id AS line
  FROM cand c LEFT JOIN ql USING (question_id)
  LEFT JOIN dl s ON s.question_id = c.question_id AND s.table_id = c.table_id AND s.data_type = 'schema'
  LEFT JOIN dl e ON e.question_id = c.question_id AND e.table_id = c.table_id AND e.data_type = 'cell'),
ev AS (SELECT question_id, string_agg(section, chr(10) || chr(10) ORDER BY rank) AS evidence,
  string_agg(line, chr(10) ORDER BY rank) AS candidate_map, count(*) AS num_tables FROM sec GROUP BY question_id)
"""


def evidence_frame(spark, sf_dir):
    p = plan(spark, sf_dir)
    u = R.union_ordered(hits(spark, sf_dir), ["question_id", "table_id", "data_type"])
    return p, u, EV.evidence(u, p["queries"], p["candidates"], ["question_id"])


@register("evidence_text", sql_plan_ctes() + SQL_UNION + "SELECT * FROM ev")
def evidence_text(spark, sf_dir):
    """Evidence sections in candidate order and the candidate map text."""
    return evidence_frame(spark, sf_dir)[2]


def _sql_chain() -> str:
    """The plan's CTEs with expanded queries instead of the question's words."""
    from .q_programs import SQL_EXPAND
    steps = SQL_EXPAND[SQL_EXPAND.index("t AS (SELECT question_id, list_transform"):].rstrip()
    ctes = sql_plan_ctes()
    at = ctes.index("pq AS (")
    ctes = ctes[:at] + steps + """,
ex AS (SELECT question_id, CASE kind WHEN 'column' THEN 'schema' ELSE 'cell' END AS kind, query, query_pos
       FROM (SELECT * FROM cq UNION ALL SELECT * FROM colq)),
""" + ctes[at:]
    ctes = ctes.replace("k.kind", "qs.kind").replace(
        "FROM qs JOIN cand c USING (question_id) CROSS JOIN (VALUES ('schema'), ('cell')) k(kind))", "FROM ex qs JOIN cand c USING (question_id))")
    union = SQL_UNION.replace("ORDER BY min_pos, min_rank)", "ORDER BY min_pos, min_rank, result_text)").replace(
        "ql AS (SELECT question_id, string_agg(query, ', ' ORDER BY query_pos) AS qlist FROM qs GROUP BY question_id)",
        "ql AS (SELECT question_id, string_agg(query, ', ' ORDER BY query_pos, query) FILTER (kind = 'schema') AS sq, "
        "string_agg(query, ', ' ORDER BY query_pos, query) FILTER (kind = 'cell') AS cl FROM ex GROUP BY question_id)").replace(
        "'Schema Retrieval Queries: ' || coalesce(ql.qlist, '')", "'Schema Retrieval Queries: ' || coalesce(ql.sq, '')").replace(
        "'Cell Retrieval Queries: ' || coalesce(ql.qlist, '')", "'Cell Retrieval Queries: ' || coalesce(ql.cl, '')")
    return ctes + union


@register("expanded_evidence", _sql_chain() + "SELECT * FROM ev")
def expanded_evidence(spark, sf_dir):
    """Expansion, retrieval of column queries in schemas and of cell
    queries in cells, ordered union, evidence text."""
    p = plan(spark, sf_dir)
    q = XP.builtin_expand(p["questions"], p["cells"], ["question_id"])
    h = R.retrieve(q, p["candidates"], p["docs"], ["question_id"], k=TOP_K, index=p["index"])
    u = R.union_ordered(h, ["question_id", "table_id", "data_type"])
    return EV.evidence(u, q, p["candidates"], ["question_id"])


@register("retrieved_docs_map",
          sql_plan_ctes() + SQL_UNION + """SELECT u.question_id, 'df' || CAST(c.rank AS VARCHAR) AS df_name,
  u.data_type, string_agg(u.result_text, chr(10) ORDER BY u.ord) AS docs
  FROM u JOIN cand c ON c.question_id = u.question_id AND c.table_id = u.table_id GROUP BY ALL""")
def retrieved_docs_map(spark, sf_dir):
    """Alias -> retrieved documents maps, flattened for checking."""
    p, u, _ = evidence_frame(spark, sf_dir)
    m = EV.docs_maps(u, p["candidates"], ["question_id"])
    cols = m.select("question_id", F.explode("retrieved_columns").alias("df_name", "d"), F.lit("schema").alias("data_type"))
    cells = m.select("question_id", F.explode("retrieved_cells").alias("df_name", "d"), F.lit("cell").alias("data_type"))
    return cols.unionByName(cells).select("question_id", "df_name", "data_type",
                                          F.array_join("d", "\n").alias("docs"))


def _sql_fill(tmpl: str, fields: dict[str, str]) -> str:
    lit = "'" + tmpl.replace("'", "''") + "'"
    x = f"replace(replace({lit}, '{{{{', chr(1)), '}}}}', chr(2))"
    for k, v in fields.items():
        x = f"replace({x}, '{{{k}}}', coalesce(CAST({v} AS VARCHAR), 'None'))"
    return f"replace(replace({x}, chr(1), '{{'), chr(2), '}}')"


PROMPT_LIMIT = 2000
SQL_PROMPTS = sql_plan_ctes() + SQL_UNION + f""", pr AS (SELECT ev.question_id, {_sql_fill(EV.SOLVE_TEMPLATE, {
              'num_tables': 'ev.num_tables', 'query': 'q.question', 'candidate_table_map': 'ev.candidate_map',
              'table_evidence': 'ev.evidence'})} AS p FROM ev JOIN questions q USING (question_id)),
pt AS (SELECT question_id, p, CAST(len(regexp_extract_all(p, '\\w+|[^\\w\\s]')) AS BIGINT) AS n_tokens FROM pr)
"""


def _prompts(spark, sf_dir, limit=None):
    p, u, ev = evidence_frame(spark, sf_dir)
    req = (ev.join(p["questions"], "question_id")
           .select("question_id", F.lit("databench").alias("task"), F.lit("multi").alias("agent"),
                   F.lit("solve").alias("kind"), F.col("question").alias("query"), "num_tables",
                   F.col("candidate_map").alias("candidate_table_map"), F.col("evidence").alias("table_evidence")))
    out = EV.prompts(req, EV.templates(spark), ["num_tables", "query", "candidate_table_map", "table_evidence"], limit)
    return out.select("question_id", "n_tokens", "prompt")


@register("prompt_fill", SQL_PROMPTS + "SELECT question_id, n_tokens, p AS prompt FROM pt")
def prompt_fill(spark, sf_dir):
    """SC20 J11 SC17: solve prompts from the template dimension and their token counts."""
    return _prompts(spark, sf_dir)


@register("prompt_guard",
          SQL_PROMPTS + f"""SELECT question_id, n_tokens, CASE WHEN n_tokens > {PROMPT_LIMIT}
  THEN 'Error: the prompt exceeds the context limit.' ELSE p END AS prompt FROM pt""")
def prompt_guard(spark, sf_dir):
    """the context guard on the same prompts."""
    return _prompts(spark, sf_dir, PROMPT_LIMIT)


@register("conversation_tokens")
def conversation_tokens(spark, sf_dir):
    """SC17 F10: tokens of every conversation turn by a byte-level tokenizer, and whether a guard of 256 tokens holds it back."""
    import public_tokenizers
    t = TK.with_tokens(X.load(spark, sf_dir, "conversations"), "text", public_tokenizers.path("byte_bpe_50k.json"))
    return t.select("conv_id", "turn", "n_tokens", (F.col("n_tokens") > 256).alias("held_back"))


def _sql_markdown(name: str) -> str:
    cols = X.STAR_SCHEMAS[name]
    hdr = " | ".join(c for c, _ in cols)
    row = " || ' | ' || ".join(f"coalesce({c}, 'None')" for c, _ in cols)
    return (f"(SELECT '{name}' AS table_id, '| {hdr} |' || chr(10) || '|' || repeat('---|', {len(cols)}) || "
            f"chr(10) || '| ' || string_agg({row}, ' |' || chr(10) || '| ' ORDER BY row_id) || ' |' AS markdown "
            f"FROM {X.sql_wide_rendered(name)})")


GUARD_LIMIT = 1000
BASE_TABLES = ["region", "nation", "supplier", "part"]
SQL_SHAPES = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_id, count(*) AS n_rows, {len(X.STAR_SCHEMAS[n])} AS n_cols FROM {n}"
    for n in BASE_TABLES) + "), md AS (" + " UNION ALL ".join(_sql_markdown(n) for n in BASE_TABLES) + ")"


@register("context_by_baseline",
          SQL_SHAPES + f""", info AS (SELECT table_id, string_agg(column_name || ': ' || dtype || ', ' ||
  CAST(non_null AS VARCHAR) || ' non-null', chr(10) ORDER BY col_id) AS info FROM (SELECT table_id, col_id, column_name,
  dtype, count(value) AS non_null FROM {X.sql_cells(BASE_TABLES)} GROUP BY ALL) GROUP BY table_id)
SELECT table_id, 'full' AS agent_type, markdown AS context, CAST(0 AS BIGINT) AS part FROM md UNION ALL SELECT table_id, 'schema', info, 0 FROM info""")
def context_by_baseline(spark, sf_dir):
    """Whole-table and schema-info contexts."""
    cells = C.cells_of(X.star_tables(spark, sf_dir, BASE_TABLES))
    full = EV.markdown(cells, ["table_id"]).withColumnRenamed("markdown", "context").withColumn("agent_type", F.lit("full"))
    ci = P.column_info(cells)
    line = F.concat(F.col("column_name"), F.lit(": "), F.col("dtype"), F.lit(", "),
                    F.col("non_null").cast("string"), F.lit(" non-null"))
    info = (ci.withColumn("_l", line).groupBy("table_id")
            .agg(EV._ordered_join("_l", "col_id", "\n").alias("context")))
    return full.unionByName(info.select("table_id", F.lit("schema").alias("agent_type"), "context", F.lit(0).cast("long").alias("part")))


@register("context_guard",
          SQL_SHAPES + f"""SELECT s.table_id, CASE WHEN 3 * n_rows * n_cols > {GUARD_LIMIT}
  THEN 'Error: the table is too large.' ELSE md.markdown END AS context, CAST(0 AS BIGINT) AS part FROM s JOIN md USING (table_id)""")
def context_guard(spark, sf_dir):
    """whole-table contexts behind the size guard; large tables are never rendered."""
    tabs = X.star_tables(spark, sf_dir, BASE_TABLES)
    guard = EV.size_guard(P.table_shape_wide(tabs), GUARD_LIMIT)
    small = guard.where(~F.col("too_large")).select("table_id")
    md = EV.markdown(C.cells_of(tabs).join(small, "table_id", "left_semi"), ["table_id"])
    return guard.join(md, "table_id", "left").select("table_id", F.when(
        F.col("too_large"), F.lit("Error: the table is too large.")).otherwise(F.col("markdown")).alias("context"),
        F.coalesce("part", F.lit(0)).alias("part"))


def _sql_random_markdown(name: str, k: int, seed: int) -> str:
    cols = X.STAR_SCHEMAS[name]
    row = " || ' | ' || ".join(f"coalesce({c}, 'None')" for c, _ in cols)
    return (f"SELECT '{name}' AS table_id, '| {' | '.join(c for c, _ in cols)} |' || chr(10) || '|' || repeat('---|', {len(cols)}) || chr(10) || '| ' || "
            f"string_agg({row}, ' |' || chr(10) || '| ' ORDER BY row_id) || ' |' AS context FROM (SELECT *, row_number() OVER ("
            f"ORDER BY md5('{seed}:' || CAST(row_id AS VARCHAR)), row_id) AS k FROM {X.sql_wide_rendered(name)}) WHERE k <= {k}")


RANDOM_K = 8


@register("context_random", SQL_SHAPES.split(", md AS")[0] + ", r AS (" + " UNION ALL ".join(_sql_random_markdown(n, RANDOM_K, 3) for n in BASE_TABLES) + f""")
SELECT s.table_id, CASE WHEN 3 * {RANDOM_K} * n_cols > 140 THEN 'Error: the table is too large.' ELSE r.context END AS context, CAST(0 AS BIGINT) AS part FROM s JOIN r USING (table_id)""")
def context_random(spark, sf_dir):
    """Contexts of random rows of each table, in row order, behind the guard on the sample's size."""
    tabs = X.star_tables(spark, sf_dir, BASE_TABLES)
    return EV.random_context(C.cells_of(tabs), P.table_shape_wide(tabs), RANDOM_K, 3, 140)


@register("table_preview",
          f"""WITH c AS {X.sql_cells(['part', 'customer'])}, s AS (SELECT table_id, max(row_id) + 1 AS n_rows,
  max(col_id) + 1 AS n_cols FROM c GROUP BY table_id)
SELECT c.table_id, c.row_id, c.col_id, c.value FROM c JOIN s USING (table_id)
WHERE (c.row_id < 3 OR c.row_id >= s.n_rows - 3) AND (c.col_id < 3 OR c.col_id >= s.n_cols - 3)
UNION ALL SELECT table_id, -1, -1, '...' FROM s WHERE n_rows > 6
UNION ALL SELECT table_id, -2, -1, '...' FROM s WHERE n_cols > 6""")
def table_preview(spark, sf_dir):
    """Head and tail rows and columns with ellipsis markers."""
    tabs = X.star_tables(spark, sf_dir, ["part", "customer"])
    shape = P.table_shape_wide(tabs)
    return EV.preview(C.cells_of(tabs), shape, 6)


@register("random_sample",
          f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || CAST(row_id AS VARCHAR)), row_id) AS k
  FROM {X.sql_wide_rendered('customer')})
SELECT 'customer' AS table_id, '| {' | '.join(c for c, _ in X.STAR_SCHEMAS['customer'])} |' || chr(10) || '|' ||
  repeat('---|', {len(X.STAR_SCHEMAS['customer'])}) || chr(10) || '| ' || string_agg({" || ' | ' || ".join(
      f"coalesce({c}, 'None')" for c, _ in X.STAR_SCHEMAS['customer'])}, ' |' || chr(10) || '| ' ORDER BY row_id) || ' |' AS markdown, CAST(0 AS BIGINT) AS part
FROM r WHERE k <= 5""")
def random_sample(spark, sf_dir):
    """5 seeded-random rows of customer, rendered in row order."""
    tabs = X.star_tables(spark, sf_dir, ["customer"])
    s = EV.random_rows(C.cells_of(tabs), 5, seed=7)
    return EV.markdown(s, ["table_id"])
