"""Registered queries: answers, votes, accuracy, summaries, selection, usage,
export, resume and checks (SC1-SC10, SC19, SC21, SC24, A1-A10, A17, F7, F8,
F12-F16, F19, U2, U4, K3-K5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import checks as CH
from ..operators import evaluate as E
from ..operators.cells import dense_row_ids
from ..session import scratch_path
from ..sources import files as FS
from . import fixtures as X
from .registry import register
from .sql_answers import (sql_date_parts, sql_normalize, sql_normalize_answer, sql_number, sql_number_print,
                          sql_value_printed)

R = X.SQL_RESULTS


# --- answers ----------------------------------------------------------------------

def answer_texts(spark, sf_dir):
    """Answer strings derived from customer, part and orders."""
    c = X.load(spark, sf_dir, "customer")
    p = X.load(spark, sf_dir, "part")
    o = X.load(spark, sf_dir, "orders")
    from ..functions.render import render_double
    return (c.select(F.lit("customer").alias("src"), F.col("c_custkey").alias("key"),
                     render_double(F.col("c_acctbal")).alias("text"))
            .unionByName(p.select(F.lit("part").alias("src"), F.col("p_partkey").alias("key"),
                                  F.concat(F.lit("$"), F.col("p_size").cast("string")).alias("text")))
            .unionByName(p.select(F.lit("part_name").alias("src"), F.col("p_partkey").alias("key"),
                                  F.concat(F.col("p_name"), F.lit(" and "), F.col("p_type")).alias("text")))
            .unionByName(o.select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("key"),
                                  F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-'xx'"))
                                  .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-'xx'-'xx'"))
                                  .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("text")))
            .unionByName(o.select(F.lit("orders_list").alias("src"), F.col("o_orderkey").alias("key"),
                                  F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('", "'),
                                           F.col("o_orderstatus"), F.lit('"]')).alias("text"))))


SQL_ANSWER_TEXTS = f"""(SELECT 'customer' AS src, c_custkey AS key,
  {X.sql_render('c_acctbal', 'double')} AS text FROM customer
UNION ALL SELECT 'part', p_partkey, '$' || CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT 'part_name', p_partkey, p_name || ' and ' || p_type FROM part
UNION ALL SELECT 'orders', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-xx')
  WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-xx-xx') ELSE strftime(o_orderdate, '%Y-%m-%d') END FROM orders
UNION ALL SELECT 'orders_list', o_orderkey, '["' || o_orderpriority || '", "' || o_orderstatus || '"]' FROM orders)"""


@register("answer_number",
          f"SELECT src, key, text, {sql_number('text')} AS amount, "
          f"CASE WHEN {sql_number('text')} IS NOT NULL THEN {sql_number_print(sql_number('text'))} END AS printed "
          f"FROM {SQL_ANSWER_TEXTS}")
def answer_number(spark, sf_dir):
    """SC2: parse numbers ($ prefix, ints, floats) and print them."""
    t = answer_texts(spark, sf_dir)
    n = A.parse_number(F.col("text"))
    return t.select("src", "key", "text", n.alias("amount"),
                    F.when(n.isNotNull(), A.number_print(n)).alias("printed"))


_ok, _y, _m, _d = sql_date_parts("text")


@register("answer_date",
          f"SELECT src, key, text, CASE WHEN {_ok} THEN CAST({_y} AS VARCHAR) || ',' || CAST({_m} AS VARCHAR) "
          f"|| ',' || CAST({_d} AS VARCHAR) END AS ymd FROM {SQL_ANSWER_TEXTS}")
def answer_date(spark, sf_dir):
    """SC3: 'y-m-d' with xx placeholders -> (y, m, d)."""
    t = answer_texts(spark, sf_dir)
    d = A.parse_date(F.col("text"))
    return t.select("src", "key", "text",
                    F.when(d.isNotNull(), F.format_string("%d,%d,%d", d["y"], d["m"], d["d"])).alias("ymd"))


@register("answer_normalize",
          f"SELECT src, key, text, {sql_value_printed('lower(trim(text))')} AS value_text, "
          f"{sql_normalize_answer('text')} AS normalized FROM {SQL_ANSWER_TEXTS}")
def answer_normalize(spark, sf_dir):
    """SC5 SC6: to_value printed form and the normalised answer."""
    t = answer_texts(spark, sf_dir)
    return t.select("src", "key", "text",
                    A.to_value_printed(F.lower(F.trim(F.col("text")))).alias("value_text"),
                    A.normalize_answer(F.col("text")).alias("normalized"))


@register("value_match",
          "SELECT o_orderkey, "
          f"coalesce(({sql_value_printed('a')}) = ({sql_value_printed('b')}) "
          f"OR abs({sql_number('a')} - {sql_number('b')}) < 1e-6, false) AS matched FROM ("
          "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS a, "
          "CASE WHEN o_orderkey % 2 = 0 THEN '$' || CAST(round(o_totalprice, 0) AS VARCHAR) "
          "ELSE CAST(o_totalprice + 0.0000001 AS VARCHAR) END AS b FROM orders)")
def value_match(spark, sf_dir):
    """SC8: numbers within 1e-6, equal printed values."""
    o = X.load(spark, sf_dir, "orders")
    pairs = o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("a"),
                     F.when(F.col("o_orderkey") % 2 == 0,
                            F.concat(F.lit("$"), F.round("o_totalprice", 0).cast("string")))
                     .otherwise((F.col("o_totalprice") + 0.0000001).cast("string")).alias("b"))
    v = A.with_value(A.with_value(pairs, "a", "va"), "b", "vb")
    return v.select("o_orderkey", A.value_match(F.col("va"), F.col("vb")).alias("matched"))


@register("text_normalize",
          f"SELECT 'documents' AS src, doc_id AS key, {sql_normalize('strip_accents(text)')} AS normalized "
          f"FROM documents UNION ALL SELECT 'pages', page_id, {sql_normalize('strip_accents(html)')} FROM pages")
def text_normalize(spark, sf_dir):
    """SC1: the answer normaliser (Arrow accent fold + JVM regex) on whole
    documents and whole pages."""
    d = X.load(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("key"),
                                                   F.col("text").alias("t"))
    p = X.load(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("key"),
                                              F.col("html").alias("t"))
    from ..sources.store import spread
    return spread(d.unionByName(p)).select("src", "key", A.normalize(F.col("t")).alias("normalized"))


FINANCE_CASES = [("6690(百萬)", "6690百萬"), ("1,234,567.50", "1234567.5"), ("12.00 (%)", "12%"), ("2024/3", "2024/03"),
                 ("2024/3/9", "2024/03/09"), ("2024/13/45", "2024/13/45"), ("0.10", "0.1"), ("-3.0", "-3"), ("abc", "abc"), ("", "")]


@register("finance_format",
          "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN "
          "regexp_replace(regexp_replace(format('{:,.2f}', c_acctbal), ',', '', 'g'), '\\.?0+$', '') "
          "ELSE strftime(DATE '2020-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y/%m/%d') END AS formatted "
          "FROM customer UNION ALL SELECT -(n_nationkey + 1), CASE n_nationkey "
          + " ".join(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(FINANCE_CASES)) + " END "
          f"FROM nation WHERE n_nationkey < {len(FINANCE_CASES)}")
def finance_format(spark, sf_dir):
    """SC24: thousands separators, trailing zeros, units, zero-padded y/m and y/m/d dates."""
    c = X.load(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.format_number("c_acctbal", 2)).otherwise(
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")),
                      "yyyy/M/d"))
    n = X.load(spark, sf_dir, "nation").where(F.col("n_nationkey") < len(FINANCE_CASES))
    case = F.element_at(F.array(*[F.lit(x) for x, _ in FINANCE_CASES]), (F.col("n_nationkey") + 1).cast("int"))
    both = c.select(F.col("c_custkey").cast("long").alias("c_custkey"), raw.alias("raw")).unionByName(
        n.select((-(F.col("n_nationkey") + 1)).cast("long").alias("c_custkey"), case.alias("raw")))
    return both.select("c_custkey", A.finance_format(F.col("raw")).alias("formatted"))


@register("answer_format",
          f"SELECT event_id, CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN '[\"a\", ' || {X._sql_rd('value')} || ']' "
          f"WHEN 'error' THEN '' WHEN 'signup' THEN {X._sql_rd('value')} ELSE event_type END AS response FROM events")
def answer_format(spark, sf_dir):
    """SC10: parsed JSON answers (bool, list, null, number, text) as response text."""
    e = X.load(spark, sf_dir, "events")
    js = (F.when(F.col("event_type") == "click", F.lit("true"))
          .when(F.col("event_type") == "view", F.concat(F.lit('["a",'), F.col("value").cast("string"), F.lit("]")))
          .when(F.col("event_type") == "error", F.lit("null"))
          .when(F.col("event_type") == "signup", F.col("value").cast("string"))
          .otherwise(F.concat(F.lit('" '), F.col("event_type"), F.lit(' "'))))
    return e.select("event_id", A.format_answer(F.parse_json(js), js).alias("response"))


# --- votes and accuracy -------------------------------------------------------------

@register("vote_qa",
          f"""WITH r AS (SELECT *, {sql_normalize_answer('answer')} AS na, {sql_normalize_answer('label')} AS nl FROM {R}),
c AS (SELECT id, na, count(*) AS n, min(sc_id) AS first FROM r GROUP BY id, na),
p AS (SELECT id, arg_max(na, struct_pack(n := n, f := -first)) AS pred FROM c GROUP BY id),
l AS (SELECT id, arg_min(nl, sc_id) AS label FROM r GROUP BY id)
SELECT p.id, pred, label, pred = label AS correct FROM p JOIN l USING (id)""")
def vote_qa(spark, sf_dir):
    """A1 A3 A4: majority vote of normalised answers per question."""
    return E.vote_qa(X.results(spark, sf_dir))


FACT = ("CASE event_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'True' ELSE 'false' END")


@register("vote_factcheck",
          f"""WITH r AS (SELECT id, sc_id, {FACT} AS answer, user_id % 2 AS label FROM {R}),
c AS (SELECT id, answer, count(*) AS n, min(sc_id) AS first FROM r GROUP BY id, answer),
p AS (SELECT id, arg_max(answer, struct_pack(n := n, f := -first)) AS pred FROM c GROUP BY id),
l AS (SELECT id, CAST(arg_min(label, sc_id) AS BIGINT) AS label FROM r GROUP BY id)
SELECT p.id, pred, label, coalesce((CASE lower(pred) WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no'
  ELSE lower(pred) END = 'yes' AND label = 1) OR (CASE lower(pred) WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no'
  ELSE lower(pred) END = 'no' AND label = 0), false) AS correct FROM p JOIN l USING (id)""")
def vote_factcheck(spark, sf_dir):
    """A2 SC7: fact-check vote on raw answers."""
    r = X.results(spark, sf_dir)
    fact = (F.when(F.col("event_id") % 4 == 0, "Yes").when(F.col("event_id") % 4 == 1, "no")
            .when(F.col("event_id") % 4 == 2, "True").otherwise("false"))
    r = r.select("id", "sc_id", fact.alias("answer"), (F.col("user_id") % 2).alias("label"))
    return E.vote_factcheck(r)


def table_sizes(spark, sf_dir):
    o = X.load(spark, sf_dir, "orders")
    return (o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_row"))
            .select(F.concat(F.lit("databench-"), F.col("o_custkey").cast("string")).alias("id"), "n_row",
                    F.lit(6).cast("long").alias("n_col")))


@register("accuracy_by_size",
          f"""WITH r AS (SELECT *, {sql_normalize_answer('answer')} AS na, {sql_normalize_answer('label')} AS nl FROM {R}),
c AS (SELECT id, na, count(*) AS n, min(sc_id) AS first FROM r GROUP BY id, na),
p AS (SELECT id, arg_max(na, struct_pack(n := n, f := -first)) AS pred FROM c GROUP BY id),
l AS (SELECT id, arg_min(nl, sc_id) AS label FROM r GROUP BY id),
v AS (SELECT p.id, pred = label AS correct FROM p JOIN l USING (id)),
s AS (SELECT 'databench-' || CAST(o_custkey AS VARCHAR) AS id, count(*) AS n_row, 6 AS n_col FROM orders GROUP BY o_custkey)
SELECT CASE WHEN n_row * n_col < 60 THEN 'small' ELSE 'large' END AS size_class, count(*) AS n_questions,
       avg(CAST(correct AS INTEGER)) AS accuracy FROM v JOIN s USING (id) GROUP BY 1""")
def accuracy_by_size(spark, sf_dir):
    """Accuracy split by total cells of the question's table."""
    per_id = E.vote_qa(X.results(spark, sf_dir))
    j = E.size_split(per_id, table_sizes(spark, sf_dir), 60)
    return j.groupBy("size_class").agg(F.count(F.lit(1)).alias("n_questions"),
                                       F.avg(F.col("correct").cast("int")).alias("accuracy"))


@register("describe_stats",
          "SELECT * FROM (" + " UNION ALL ".join(
              f"SELECT '{st}' AS stat, " + ", ".join(
                  f"round(CAST({fn.format(c=c)} AS DOUBLE), 6) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount"))
              + " FROM lineitem"
              for st, fn in [("count", "count({c})"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
                             ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"),
                             ("50%", "quantile_cont({c}, 0.5)"), ("75%", "quantile_cont({c}, 0.75)"),
                             ("max", "max({c})")]) + ")")
def describe_stats(spark, sf_dir):
    """A5: count, mean, std, min, quartiles, max of lineitem measures."""
    li = X.load(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    d = E.describe(li, cols)
    return d.select("stat", *[F.round(c, 6).alias(c) for c in cols])


@register("run_summary",
          f"""WITH r AS (SELECT *, {sql_normalize_answer('answer')} AS na, {sql_normalize_answer('label')} AS nl FROM {R}),
c AS (SELECT id, na, count(*) AS n, min(sc_id) AS first FROM r GROUP BY id, na),
p AS (SELECT id, arg_max(na, struct_pack(n := n, f := -first)) AS pred FROM c GROUP BY id),
l AS (SELECT id, arg_min(nl, sc_id) AS label FROM r GROUP BY id),
v AS (SELECT p.id, CAST(pred = label AS INTEGER) AS correct FROM p JOIN l USING (id)),
s AS (SELECT 'databench-' || CAST(o_custkey AS VARCHAR) AS id, count(*) * 6 AS total_cell FROM orders GROUP BY o_custkey),
m AS (SELECT avg(n_iter) AS n_iter, avg(init_prompt_token_count) AS init_prompt_token_count,
             avg(total_token_count) AS total_token_count FROM r)
SELECT d.data, round(m.n_iter, 6) AS n_iter, round(m.init_prompt_token_count, 6) AS init_prompt_token_count,
       round(m.total_token_count, 6) AS total_token_count, round(d.accuracy, 6) AS accuracy,
       'builtin' AS model_name, 'hashed' AS embed_model_name, 'databench' AS task, 'multi' AS agent_type,
       CAST(5 AS BIGINT) AS top_k, CAST(1 AS BIGINT) AS sc, CAST(1000 AS BIGINT) AS max_encode_cell FROM m, (
  SELECT 'events' AS data, avg(correct) AS accuracy FROM v
  UNION ALL SELECT 'events-small', avg(correct) FROM v JOIN s USING (id) WHERE total_cell < 60
  UNION ALL SELECT 'events-large', avg(correct) FROM v JOIN s USING (id) WHERE total_cell >= 60) d""")
def run_summary(spark, sf_dir):
    """Mean stats + accuracy, overall and for the small / large split."""
    r = X.results(spark, sf_dir)
    per_id = E.vote_qa(r)
    means = r.agg(*[F.avg(c).alias(c) for c in ("n_iter", "init_prompt_token_count", "total_token_count")])
    split = E.size_split(per_id, table_sizes(spark, sf_dir), 60)
    acc = (E.accuracy(per_id).select(F.lit("events").alias("data"), "accuracy")
           .unionByName(split.groupBy(F.concat(F.lit("events-"), F.col("size_class")).alias("data"))
                        .agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))))
    names = ["n_iter", "init_prompt_token_count", "total_token_count"]
    both = acc.unionByName(means, allowMissingColumns=True)
    every = Window.partitionBy()          # the summary's few rows
    both = both.select("data", "accuracy", *[F.round(F.max(c).over(every), 6).alias(c) for c in names]).where("data is not null")
    return both.select("data", *names, F.round("accuracy", 6).alias("accuracy"), *[F.lit(v).alias(k) for k, v in RUN_CONFIG.items()])


# The run configuration recorded next to the summary (K5).
RUN_CONFIG = {"model_name": "builtin", "embed_model_name": "hashed", "task": "databench", "agent_type": "multi",
              "top_k": 5, "sc": 1, "max_encode_cell": 1000}


# --- selection, usage ---------------------------------------------------------------

def selection_records(spark, sf_dir):
    """Selected = first candidate supplier, gold = supplier of the largest line;
    no selection for every 11th order; correct = order status 'F'."""
    pos = X.candidate_positions(spark, sf_dir).where(F.col("position") == 1)
    gold = X.gold_suppliers(spark, sf_dir)
    o = X.load(spark, sf_dir, "orders")
    j = pos.join(gold, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    sel = F.when(F.col("l_orderkey") % 11 != 0, F.col("l_suppkey"))
    return j.select("l_orderkey",
                    F.when(sel.isNotNull(), F.coalesce(sel == F.col("gold"), F.lit(False))).alias("selected_is_gold"),
                    A.stripped_equal(F.col("o_orderstatus"), F.lit("F")).alias("is_correct"))


@register("selection_breakdown",
          f"""WITH rec AS (SELECT p.l_orderkey, CASE WHEN p.l_orderkey % 11 <> 0 THEN p.l_suppkey = g.gold END AS sg,
  coalesce(regexp_replace(o.o_orderstatus, '^\\s+|\\s+$', '', 'g'), '') = 'F' AS ok FROM {X.SQL_CANDIDATE_POSITIONS} p
  JOIN {X.SQL_GOLD_SUPPLIERS} g USING (l_orderkey) JOIN orders o ON o.o_orderkey = p.l_orderkey WHERE p.position = 1),
s AS (SELECT count(*) AS total, count_if(sg) AS gold, count_if(NOT sg) AS wrong, count_if(ok) AS correct,
  count_if(NOT ok) AS incorrect, count_if(sg AND ok) AS gc, count_if(sg AND NOT ok) AS gw,
  count_if(NOT sg AND ok) AS wc, count_if(NOT sg AND NOT ok) AS ww FROM rec WHERE sg IS NOT NULL)
SELECT metric, CAST(n AS BIGINT) AS n, CAST(d AS BIGINT) AS d, round(n / nullif(d, 0), 6) AS rate FROM (
  SELECT 'selected_gold' AS metric, gold AS n, total AS d FROM s UNION ALL SELECT 'selected_wrong', wrong, total FROM s
  UNION ALL SELECT 'answer_correct', correct, total FROM s UNION ALL SELECT 'answer_wrong', incorrect, total FROM s
  UNION ALL SELECT 'correct_given_gold', gc, gold FROM s UNION ALL SELECT 'wrong_given_gold', gw, gold FROM s
  UNION ALL SELECT 'correct_given_wrong', wc, wrong FROM s UNION ALL SELECT 'wrong_given_wrong', ww, wrong FROM s)
UNION ALL SELECT 'skipped', CAST(count(*) AS BIGINT), CAST(count(*) AS BIGINT), NULL FROM rec WHERE sg IS NULL""")
def selection_breakdown(spark, sf_dir):
    """A9 SC9 SC23 F13: table selection vs answer correctness."""
    b = E.selection_breakdown(selection_records(spark, sf_dir))
    return b.select("metric", "n", "d", F.round("rate", 6).alias("rate"))


@register("token_rollup",
          "SELECT CAST(sum(coalesce(input_token_count, 0)) AS BIGINT) AS input_tokens, "
          "CAST(sum(coalesce(output_token_count, 0)) AS BIGINT) AS output_tokens, "
          "CAST(sum(coalesce(total_token_count, coalesce(input_token_count, 0) + coalesce(output_token_count, 0))) "
          f"AS BIGINT) AS total_tokens, count(*) AS n_records FROM {R}")
def token_rollup(spark, sf_dir):
    """Token totals over all result records."""
    return E.token_rollup(X.results(spark, sf_dir))


@register("call_usage",
          "SELECT id, CAST(sum(coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE total_token_count END, 0), "
          "input_token_count + output_token_count)) AS BIGINT) AS tokens, count(*) AS n_calls "
          f"FROM {R} GROUP BY id")
def call_usage(spark, sf_dir):
    """API usage when reported, else the estimate, summed per question."""
    r = X.results(spark, sf_dir)
    calls = r.select("id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("total_token_count"))
                     .alias("api_total"), F.col("input_token_count").alias("est_input"),
                     F.col("output_token_count").alias("est_output"))
    return E.call_usage(calls)


# --- export, resume, checks --------------------------------------------------------------

@register("responses_export",
          "SELECT CAST(user_id AS BIGINT) AS ord, id, coalesce(regexp_replace(regexp_replace(answer || CASE WHEN event_id % 13 = 0 "
          f"THEN chr(10) || 'x' ELSE '' END, '[\\r\\n]', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS line FROM {R} WHERE sc_id = 0")
def responses_export(spark, sf_dir):
    """K3 D5 SC19 SC21 F12: one cleaned answer line per question, ordered by id number."""
    r = X.results(spark, sf_dir)
    r = r.withColumn("answer", F.concat("answer", F.when(F.col("event_id") % 13 == 0, F.lit("\nx")).otherwise(F.lit(""))))
    return E.responses(r, 0)


@register("resume_pending",
          f"""WITH q AS (SELECT DISTINCT id, user_id FROM {R}), t AS (SELECT id, user_id, unnest(range(0, 80)) AS sc_id FROM q
  WHERE user_id >= 10)
SELECT t.id, CAST(t.sc_id AS BIGINT) AS sc_id FROM t ANTI JOIN {R} d ON d.id = t.id AND d.sc_id = t.sc_id""")
def resume_pending(spark, sf_dir):
    """Questions from position 10 on, 80 runs each, minus the runs already logged."""
    r = X.results(spark, sf_dir)
    q = r.select("id", "user_id").distinct().where(F.col("user_id") >= 10)
    tasks = E.fan_out(q, 80)
    return E.pending(tasks, r).select("id", "sc_id")


@register("checks",
          """WITH c AS (
  SELECT 'unique_order_ids' AS check_name, (SELECT count(*) FROM orders) AS expected,
         (SELECT count(DISTINCT o_orderkey) FROM orders) AS actual
  UNION ALL SELECT 'candidates_exist', 0, (SELECT count(*) FROM lineitem l ANTI JOIN supplier s ON s.s_suppkey = l.l_suppkey)
  UNION ALL SELECT 'parts_exist', 0, (SELECT count(*) FROM lineitem l ANTI JOIN part p ON p.p_partkey = l.l_partkey)
  UNION ALL SELECT 'order_ids_complete', 0, (SELECT count(*) FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1
         FROM orders))) AS k) r ANTI JOIN orders o ON o.o_orderkey = r.k)
  UNION ALL SELECT 'lines_have_orders', 0, (SELECT count(*) FROM lineitem l ANTI JOIN orders o ON o.o_orderkey = l.l_orderkey)
  UNION ALL SELECT 'records_match_questions', (SELECT count(*) FROM orders),
         (SELECT count(DISTINCT l_orderkey) FROM lineitem)
  UNION ALL SELECT 'question_sets_equal', 0, (SELECT count(*) FROM (
         SELECT DISTINCT l_orderkey FROM lineitem l ANTI JOIN orders o ON o.o_orderkey = l.l_orderkey)) +
         (SELECT count(*) FROM orders o ANTI JOIN lineitem l ON l.l_orderkey = o.o_orderkey))
SELECT check_name, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS ok FROM c""")
def checks(spark, sf_dir):
    """Existence, uniqueness and completeness assertions."""
    o, li = X.load(spark, sf_dir, "orders"), X.load(spark, sf_dir, "lineitem")
    s, p = X.load(spark, sf_dir, "supplier"), X.load(spark, sf_dir, "part")
    records = li.agg(F.count_distinct("l_orderkey").alias("v"))
    return CH.run([CH.unique("unique_order_ids", o, "o_orderkey"), CH.exists("candidates_exist", li, s, "l_suppkey", "s_suppkey"),
                   CH.exists("parts_exist", li, p, "l_partkey", "p_partkey"), CH.complete("order_ids_complete", o, "o_orderkey"),
                   CH.exists("lines_have_orders", li, o, "l_orderkey", "o_orderkey"),
                   CH.check("records_match_questions", CH.count_of(o), records),
                   CH.same_set("question_sets_equal", li, o, "l_orderkey", "o_orderkey")])


@register("missing_ids",
          "SELECT k AS ord FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 1 FROM orders))) AS k) r "
          "ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = r.k")
def missing_ids(spark, sf_dir):
    """The question ids (0..n-1) without a response (here: orders without lines)."""
    o = X.load(spark, sf_dir, "orders")
    n = o.agg(F.max("o_orderkey")).first()[0] + 1
    present = X.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord")).distinct()
    return E.missing_ids(present, int(n))


@register("responses_sink",
          "SELECT CAST(row_number() OVER (ORDER BY CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) - 1 AS BIGINT) AS position, "
          "coalesce(regexp_replace(regexp_replace(answer, '[\\r\\n]', ' ', 'g'), "
          f"'^\\s+|\\s+$', '', 'g'), '') AS line FROM {R} WHERE sc_id = 0")
def responses_sink(spark, sf_dir):
    """The answer lines written in question order and read back, with their place over all part files."""
    path = scratch_path(spark, "responses")
    FS.write_responses(E.responses(X.results(spark, sf_dir), 0), path)
    lines = dense_row_ids(FS.read_lines(spark, path), ["file_path", "line_no"], col="position")
    return lines.select("position", F.col("value").alias("line"))


@register("usage_sink",
          "SELECT CAST(sum(coalesce(input_token_count, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_token_count, 0)) AS BIGINT) "
          "AS output_tokens, CAST(sum(coalesce(total_token_count, coalesce(input_token_count, 0) + coalesce(output_token_count, 0))) AS BIGINT) "
          f"AS total_tokens, count(*) AS n_records FROM {R}")
def usage_sink(spark, sf_dir):
    """K4: the token usage summary written and read back."""
    path = scratch_path(spark, "usage")
    FS.write_usage(E.token_rollup(X.results(spark, sf_dir)), path)
    return spark.read.schema("input_tokens long, output_tokens long, total_tokens long, n_records long").json(path)
