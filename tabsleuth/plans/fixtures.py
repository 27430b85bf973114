"""Inputs derived from the driver tables (FIXTURES.md section 2).

Each derivation exists twice: as a Spark DataFrame and as DuckDB SQL text
for the oracle, and both must describe the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import SQL_RENDER_DOUBLE, SQL_RENDER_TS
from ..operators.cells import dense_row_ids

# The declared key order that defines row_id of each table.
STAR_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
}

# Column types of the star tables (used to generate the oracle SQL).
STAR_SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
}

DIM_TABLES = ["region", "nation", "customer", "supplier", "part"]
ALL_STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

_DTYPE = {"int": "int32", "bigint": "int64", "double": "float64", "string": "object",
          "timestamp": "datetime64[ns]"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYED: dict = {}


def session_memo(spark: SparkSession, key: tuple, build):
    """Reuse a DataFrame backed by written tables within one application
    (the written folders live as long as the shared checkpoint folder)."""
    k = (spark.sparkContext.applicationId, *key)
    if k not in _KEYED:
        _KEYED[k] = build()
    return _KEYED[k]


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star table with ``row_id`` = position in its declared key order
    (keyed once per application and data folder, then reused)."""
    return session_memo(spark, ("star", sf_dir, name),
                        lambda: dense_row_ids(load(spark, sf_dir, name), STAR_KEYS[name]))


def star_tables(spark: SparkSession, sf_dir: str, names=DIM_TABLES) -> dict[str, DataFrame]:
    """Keyed star tables; the independent per-table id jobs are submitted
    concurrently (Spark schedules jobs from several driver threads)."""
    from concurrent.futures import ThreadPoolExecutor
    names = list(names)
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(names)))) as pool:
        frames = list(pool.map(lambda n: star_table(spark, sf_dir, n), names))
    return dict(zip(names, frames))


# --- oracle SQL -------------------------------------------------------------

def sql_star(name: str) -> str:
    keys = ", ".join(STAR_KEYS[name])
    return f"(SELECT *, CAST(row_number() OVER (ORDER BY {keys}) - 1 AS BIGINT) AS row_id FROM {name})"


def sql_render(col: str, typ: str) -> str:
    if typ in ("int", "bigint"):
        return f"CAST({col} AS VARCHAR)"
    if typ == "double":
        return SQL_RENDER_DOUBLE.format(x=col)
    if typ == "timestamp":
        return SQL_RENDER_TS.format(x=col)
    return col


def sql_cells(names, stringify: bool = False) -> str:
    """DuckDB twin of ``cells_of(star_tables(...))``."""
    parts = []
    for n in names:
        for i, (c, t) in enumerate(STAR_SCHEMAS[n]):
            numeric = t in ("int", "bigint", "double") and not stringify
            dtype = "object" if stringify else _DTYPE[t]
            num = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT '{n}' AS table_id, row_id, CAST({i} AS BIGINT) AS col_id, '{c}' AS column_name, "
                f"'{dtype}' AS dtype, {str(numeric).lower()} AS is_numeric, "
                f"{sql_render(c, t)} AS value, {num} AS num FROM {sql_star(n)}")
    return "(" + "\nUNION ALL ".join(parts) + ")"


def sql_wide_rendered(name: str) -> str:
    """All columns of a star table rendered to text, plus row_id."""
    cols = ", ".join(f"{sql_render(c, t)} AS {c}" for c, t in STAR_SCHEMAS[name])
    return f"(SELECT row_id, {cols} FROM {sql_star(name)})"


# --- derived question sets ----------------------------------------------------

def supplier_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per supplier, naming the supplier and its nation."""
    s = load(spark, sf_dir, "supplier")
    n = load(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").alias("question_id"),
                    F.concat(F.lit("Which customers and parts are linked to "), F.col("s_name"),
                             F.lit(" in "), F.col("n_name"), F.lit("?")).alias("question")))


SQL_SUPPLIER_QUESTIONS = (
    "(SELECT s_suppkey AS question_id, 'Which customers and parts are linked to ' || s_name "
    "|| ' in ' || n_name || '?' AS question FROM supplier JOIN nation ON s_nationkey = n_nationkey)")


# --- result records (r1), selection records, answers ----------------------------

# Fixed value: the label of a question is one of the five event types by user_id % 5.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result record per event: id = user, sc_id = order of the user's
    events (written once per application and data folder)."""
    from ..sources.store import materialize
    return session_memo(spark, ("results", sf_dir), lambda: materialize(_results(spark, sf_dir), "results"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cells import group_ordinals
    e = group_ordinals(load(spark, sf_dir, "events"), ["user_id"], ["event_id"], col="sc_id")
    inp = (F.col("value") * 10).cast("long")
    out = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.concat(F.lit("databench-"), F.col("user_id").cast("string")).alias("id"),
        "sc_id", "user_id", "event_id",
        F.col("event_type").alias("answer"),
        F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), (F.col("user_id") % 5 + 1).cast("int")).alias("label"),
        inp.alias("input_token_count"), out.alias("output_token_count"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("long")).otherwise(inp + out).alias("total_token_count"),
        (F.col("event_id") % 10 + 1).alias("n_iter"),
        (F.col("value") * 100).cast("long").alias("init_prompt_token_count"),
        "value", "ts")


SQL_RESULTS = (
    "(SELECT 'databench-' || CAST(user_id AS VARCHAR) AS id, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS sc_id, user_id, event_id, "
    "event_type AS answer, ['click','error','purchase','signup','view'][user_id % 5 + 1] AS label, "
    "CAST(trunc(value * 10) AS BIGINT) AS input_token_count, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_token_count, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(trunc(value * 10) AS BIGINT) + "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) END AS total_token_count, "
    "event_id % 10 + 1 AS n_iter, CAST(trunc(value * 100) AS BIGINT) AS init_prompt_token_count, value, ts "
    "FROM events)")


def candidate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval output (c1): question = order, candidates = its suppliers by line."""
    from ..operators.cells import group_ordinals
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    return (group_ordinals(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                           col="pos")
            .withColumn("position", F.col("pos") + 1).drop("pos"))


SQL_CANDIDATE_POSITIONS = (
    "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) "
    "AS position FROM lineitem)")


def gold_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold table of a question: supplier of its largest line (tie: smallest supplier)."""
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy("l_orderkey")
            .agg(F.max_by("l_suppkey", F.struct(F.col("l_extendedprice"), -F.col("l_suppkey"))).alias("gold")))


SQL_GOLD_SUPPLIERS = (
    "(SELECT l_orderkey, arg_max(l_suppkey, struct_pack(p := l_extendedprice, s := -l_suppkey)) AS gold "
    "FROM lineitem GROUP BY l_orderkey)")


def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval output (c1) as JSON text per question, mixed shapes:
    candidates as string / [id, score] / dict by part key, records as a
    bare list or under "top_tables" / "results" by order key."""
    from ..functions.render import render_double
    li = load(spark, sf_dir, "lineitem").where(F.col("l_orderkey").isNotNull())
    # an order's lines meet once, in position order: the position is the place in the list
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")

    def candidate(s, i):
        supp = s["l_suppkey"].cast("string")
        tid = F.concat(F.lit("S"), supp)
        idkey = F.when(s["l_linenumber"] % 2 == 1, F.lit("table_name")).otherwise(F.lit("table_id"))
        return (F.when(s["l_partkey"] % 3 == 0, F.concat(F.lit('"'), tid, F.lit('"')))
                .when(s["l_partkey"] % 3 == 1, F.concat(F.lit('["'), tid, F.lit('", '), render_double(s["l_discount"]), F.lit("]")))
                .otherwise(F.concat(F.lit('{"'), idkey, F.lit('": "'), tid, F.lit('", "rank": '),
                                    (i + 1).cast("string"), F.lit(', "caption": "supplier '), supp, F.lit('", "score": '),
                                    render_double(s["l_tax"]), F.lit(', "bm25_score": '), render_double(s["l_quantity"]), F.lit("}"))))
    lst = (li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
           .select("l_orderkey", F.array_join(F.transform("lines", candidate), ", ").alias("body")))
    body = F.concat(F.lit("["), F.col("body"), F.lit("]"))
    k = F.col("l_orderkey").cast("string")
    rec = (F.when(F.col("l_orderkey") % 3 == 0, body)
           .when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit('{"query_index": '), k, F.lit(', "top_tables": '),
                                                      body, F.lit("}")))
           .otherwise(F.concat(F.lit('{"query_index": '), k, F.lit(', "results": '), body, F.lit("}"))))
    return lst.select("l_orderkey", rec.alias("record"))


def _sql_rd(x: str) -> str:
    return SQL_RENDER_DOUBLE.format(x=x)


SQL_RETRIEVAL_RECORDS = f"""(WITH p AS {SQL_CANDIDATE_POSITIONS},
c AS (SELECT l_orderkey, position, CASE WHEN l_partkey % 3 = 0 THEN '"S' || CAST(l_suppkey AS VARCHAR) || '"'
  WHEN l_partkey % 3 = 1 THEN '["S' || CAST(l_suppkey AS VARCHAR) || '", ' || {_sql_rd('l_discount')} || ']'
  ELSE '{{"' || CASE WHEN l_linenumber % 2 = 1 THEN 'table_name' ELSE 'table_id' END || '": "S'
    || CAST(l_suppkey AS VARCHAR) || '", "rank": ' || CAST(position AS VARCHAR) || ', "caption": "supplier '
    || CAST(l_suppkey AS VARCHAR) || '", "score": ' || {_sql_rd('l_tax')} || ', "bm25_score": '
    || {_sql_rd('l_quantity')} || '}}' END AS cj FROM p),
l AS (SELECT l_orderkey, '[' || string_agg(cj, ', ' ORDER BY position) || ']' AS body FROM c GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN body
  WHEN l_orderkey % 3 = 1 THEN '{{"query_index": ' || CAST(l_orderkey AS VARCHAR) || ', "top_tables": ' || body || '}}'
  ELSE '{{"query_index": ' || CAST(l_orderkey AS VARCHAR) || ', "results": ' || body || '}}' END AS record FROM l)"""

SQL_NORMALIZED_CANDIDATES = f"""(WITH r AS {SQL_RETRIEVAL_RECORDS},
a AS (SELECT l_orderkey, CASE WHEN json_type(record::JSON) = 'ARRAY' THEN record::JSON
  ELSE coalesce(json_extract(record, '$.top_tables'), json_extract(record, '$.tables'),
                json_extract(record, '$.results')) END AS arr FROM r),
e AS (SELECT l_orderkey, arr, unnest(range(CAST(json_array_length(arr) AS BIGINT))) AS i FROM a),
x AS (SELECT l_orderkey, i + 1 AS position, json_extract(arr, '$[' || CAST(i AS VARCHAR) || ']') AS cand FROM e)
SELECT l_orderkey, CAST(position AS BIGINT) AS position,
  CAST(CASE WHEN json_type(cand) = 'OBJECT' THEN coalesce(TRY_CAST(json_extract_string(cand, '$.rank') AS INTEGER), position)
       ELSE position END AS BIGINT) AS rank,
  CASE json_type(cand) WHEN 'VARCHAR' THEN json_extract_string(cand, '$') WHEN 'ARRAY' THEN json_extract_string(cand, '$[0]')
       ELSE coalesce(json_extract_string(cand, '$.table_id'), json_extract_string(cand, '$.table_name'),
                     json_extract_string(cand, '$.dataset'), json_extract_string(cand, '$.table'),
                     json_extract_string(cand, '$.id')) END AS table_id,
  CASE json_type(cand) WHEN 'OBJECT' THEN coalesce(json_extract_string(cand, '$.title'), json_extract_string(cand, '$.caption'),
       coalesce(json_extract_string(cand, '$.table_id'), json_extract_string(cand, '$.table_name')))
       WHEN 'ARRAY' THEN json_extract_string(cand, '$[0]') ELSE json_extract_string(cand, '$') END AS title,
  CASE WHEN json_type(cand) = 'ARRAY' AND json_type(cand, '$[1]') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
       THEN CAST(json_extract_string(cand, '$[1]') AS DOUBLE)
       WHEN json_type(cand) = 'OBJECT' THEN TRY_CAST(json_extract_string(cand, '$.score') AS DOUBLE) END AS score,
  CASE WHEN json_type(cand) = 'OBJECT' THEN TRY_CAST(json_extract_string(cand, '$.bm25_score') AS DOUBLE) END AS bm25_score,
  CASE WHEN json_type(cand) = 'OBJECT' THEN TRY_CAST(json_extract_string(cand, '$.dense_score') AS DOUBLE) END AS dense_score
FROM x)"""

SQL_GOLD = f"(SELECT l_orderkey, 'S' || CAST(gold AS VARCHAR) AS gold_table_id FROM {SQL_GOLD_SUPPLIERS})"


def gold_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_suppliers(spark, sf_dir).select(
        "l_orderkey", F.concat(F.lit("S"), F.col("gold").cast("string")).alias("gold_table_id"))
