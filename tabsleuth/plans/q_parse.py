"""Registered queries: reply parsing and the answer record
(SC11-SC16, SC18, L6-L8, J6, SC23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import parse as P
from ..functions.render import render_double
from . import fixtures as X
from .registry import register


def replies(spark, sf_dir):
    """Model replies built from events: labelled, fenced, literal, action, invalid."""
    e = X.load(spark, sf_dir, "events")
    k = (F.col("user_id") % 5 + 1).cast("string")
    r = (F.when(F.col("event_id") % 5 == 0,
                F.concat(F.lit("Thought: step "), F.col("event_id").cast("string"),
                         F.lit('\nFinal Answer: {"table_source": "df'), k, F.lit('", "answer": '),
                         render_double(F.col("value")), F.lit("}")))
         .when(F.col("event_id") % 5 == 1,
               F.concat(F.lit('```json\n{"table_source": "df'), k, F.lit('", "answer": "'), F.col("event_type"),
                        F.lit('"}\n```')))
         .when(F.col("event_id") % 5 == 2,
               F.concat(F.lit("Thought: {'table_source': 'df"), k, F.lit("', 'answer': True}")))
         .when(F.col("event_id") % 5 == 3,
               F.concat(F.lit("Thought: look\nAction: ```python\ndf"), k,
                        F.lit('["value"].mean()\n```\nObservation: 1')))
         .otherwise(F.concat(F.lit("Final Answer: not json "), F.col("event_type"))))
    return e.select("event_id", "user_id", "event_type", r.alias("reply"))


SQL_REPLIES = f"""(SELECT event_id, user_id, event_type, CASE event_id % 5
  WHEN 0 THEN 'Thought: step ' || CAST(event_id AS VARCHAR) || chr(10) || 'Final Answer: {{"table_source": "df'
       || CAST(user_id % 5 + 1 AS VARCHAR) || '", "answer": ' || {X._sql_rd('value')} || '}}'
  WHEN 1 THEN '```json' || chr(10) || '{{"table_source": "df' || CAST(user_id % 5 + 1 AS VARCHAR) || '", "answer": "'
       || event_type || '"}}' || chr(10) || '```'
  WHEN 2 THEN 'Thought: {{''table_source'': ''df' || CAST(user_id % 5 + 1 AS VARCHAR) || ''', ''answer'': True}}'
  WHEN 3 THEN 'Thought: look' || chr(10) || 'Action: ```python' || chr(10) || 'df' || CAST(user_id % 5 + 1 AS VARCHAR)
       || '["value"].mean()' || chr(10) || '```' || chr(10) || 'Observation: 1'
  ELSE 'Final Answer: not json ' || event_type END AS reply FROM events)"""

_C1 = ("CASE WHEN contains(lower(regexp_replace(reply, '^\\s+|\\s+$', '', 'g')), 'final answer:') THEN regexp_replace(split_part(regexp_extract(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), "
       "'(?is).*final answer:(.*)', 1), chr(10), 1), '^\\s+|\\s+$', '', 'g') WHEN starts_with(lower(regexp_replace(reply, '^\\s+|\\s+$', '', 'g')), 'thought:') "
       "THEN regexp_replace(substr(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), 9), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(reply, '^\\s+|\\s+$', '', 'g') END")
_S = f"regexp_replace(regexp_replace({_C1}, '^`+|`+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_CAND = (f"CASE WHEN starts_with({_C1}, '```') THEN CASE WHEN starts_with(lower({_S}), 'json') "
         f"THEN regexp_replace(substr({_S}, 5), '^\\s+|\\s+$', '', 'g') ELSE {_S} END ELSE {_C1} END")
_LIT = ("regexp_replace(regexp_replace(regexp_replace(replace(cand, '''', '\"'), '\\bTrue\\b', 'true', 'g'), "
        "'\\bFalse\\b', 'false', 'g'), '\\bNone\\b', 'null', 'g')")
SQL_PARSED = f"""(WITH a AS (SELECT *, {_CAND} AS cand FROM {SQL_REPLIES}),
b AS (SELECT *, CASE WHEN json_valid(cand) THEN cand::JSON WHEN json_valid({_LIT}) THEN ({_LIT})::JSON END AS j FROM a)
SELECT *, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.table_source') AND json_exists(j, '$.answer'), false)
  AS ok FROM b)"""
SQL_FORMAT = ("CASE json_type(j, '$.answer') WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.answer') = 'true' "
              "THEN 'True' ELSE 'False' END WHEN 'NULL' THEN '' ELSE regexp_replace(json_extract_string(j, '$.answer'), '^\\s+|\\s+$', '', 'g') END")


@register("parse_final",
          f"SELECT event_id, ok, CASE WHEN ok THEN json_extract_string(j, '$.table_source') END AS table_source, "
          f"CASE WHEN ok THEN {SQL_FORMAT} END AS answer, (contains(lower(reply), 'final answer:') OR ok) AS terminal "
          f"FROM {SQL_PARSED}")
def parse_final(spark, sf_dir):
    """SC11 SC13 L8 SC10: final-answer JSON (labelled, fenced, literal), terminal flag."""
    r = replies(spark, sf_dir).withColumn("p", P.parse_final(F.col("reply")))
    return r.select("event_id", F.col("p.ok").alias("ok"), F.col("p.table_source").alias("table_source"),
                    F.when(F.col("p.ok"), A.format_answer(F.col("p.answer"), F.col("p.answer_raw"))).alias("answer"),
                    P.is_terminal(F.col("reply"), F.col("p.ok")).alias("terminal"))


@register("parse_plain",
          "SELECT event_id, CASE WHEN contains(reply, 'Answer:') THEN regexp_replace(split_part(regexp_extract(reply, "
          f"'(?s).*Answer:(.*)', 1), chr(10), 1), '^\\s+|\\s+$', '', 'g') END AS answer FROM {SQL_REPLIES}")
def parse_plain(spark, sf_dir):
    """SC12: text after the last 'Answer:'."""
    return replies(spark, sf_dir).select("event_id", P.parse_plain(F.col("reply")).alias("answer"))


_AFTER = "regexp_extract(reply, '(?s).*Action:(.*)', 1)"


@register("parse_action",
          f"SELECT event_id, CASE WHEN contains(reply, 'Action:') THEN CASE "
          f"WHEN regexp_matches({_AFTER}, '(?is)```(\\w*\\s*)?(.*?)```') THEN regexp_replace(regexp_extract({_AFTER}, '(?is)```(\\w*\\s*)?(.*?)```', 2), '^\\s+|\\s+$', '', 'g') "
          f"WHEN regexp_matches({_AFTER}, '(?s)`(.*?)`') THEN regexp_replace(regexp_extract({_AFTER}, '(?s)`(.*?)`', 1), '^\\s+|\\s+$', '', 'g') "
          f"ELSE regexp_replace({_AFTER}, '^\\s+|\\s+$', '', 'g') END END AS code FROM {SQL_REPLIES}")
def parse_action(spark, sf_dir):
    """SC14: the code of the last action (fenced, backticked or raw)."""
    return replies(spark, sf_dir).select("event_id", P.parse_action(F.col("reply")).alias("code"))


LIST_TEXT = ("CASE WHEN event_id % 3 = 0 THEN 'Sure: [\"' || event_type || '\", \"' || CAST(user_id AS VARCHAR) "
             "|| '\"] and [\"x\"]' WHEN event_id % 3 = 1 THEN 'no list here' ELSE '[\"' || event_type || '\"]' END")


@register("parse_list",
          f"SELECT event_id, array_to_string(l, '|') AS items, CAST(coalesce(len(l), 0) AS BIGINT) AS n FROM ("
          f"SELECT event_id, TRY_CAST(TRY_CAST(regexp_extract(t, '(?s)\\[.*?\\]', 0) AS JSON) AS VARCHAR[]) AS l "
          f"FROM (SELECT event_id, {LIST_TEXT} AS t FROM events))")
def parse_list(spark, sf_dir):
    """SC15: the first JSON list in a reply (single-table form: up to the first ']')."""
    e = X.load(spark, sf_dir, "events")
    t = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure: ["'), F.col("event_type"), F.lit('", "'),
                                                      F.col("user_id").cast("string"), F.lit('"] and ["x"]')))
         .when(F.col("event_id") % 3 == 1, F.lit("no list here"))
         .otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('"]'))))
    lst = P.extract_list(t, greedy=False)
    return e.select("event_id", F.array_join(lst, "|").alias("items"),
                    F.coalesce(F.when(lst.isNotNull(), F.size(lst)), F.lit(0)).cast("long").alias("n"))


@register("stop_cut",
          "SELECT event_id, CASE WHEN p IS NULL THEN reply ELSE substr(reply, 1, p - 1) END AS cut FROM ("
          "SELECT event_id, reply, least(nullif(strpos(reply, 'Observation:'), 0), "
          f"nullif(strpos(reply, chr(10) || 'Thought'), 0)) AS p FROM {SQL_REPLIES})")
def stop_cut(spark, sf_dir):
    """SC16: cut a reply at the earliest stop sequence."""
    return replies(spark, sf_dir).select("event_id", P.stop_cut(F.col("reply")).alias("cut"))


OUT_TEXT = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || chr(10) || 'b' ELSE event_type END"


@register("observation_text",
          f"SELECT event_id, CASE WHEN code IS NULL THEN 'Error: no action found.' "
          f"WHEN coalesce(regexp_replace(o, '^\\s+|\\s+$', '', 'g'), '') = '' THEN 'success!' WHEN contains(o, chr(10)) THEN chr(10) || o ELSE o END AS obs "
          f"FROM (SELECT event_id, {OUT_TEXT} AS o, CASE WHEN contains(reply, 'Action:') THEN 'x' END AS code "
          f"FROM {SQL_REPLIES})")
def observation_text(spark, sf_dir):
    """SC18: observation text of an action's output."""
    r = replies(spark, sf_dir)
    out = (F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit("a\nb"))
           .otherwise(F.col("event_type")))
    return r.select("event_id", P.observation_text(P.parse_action(F.col("reply")), out).alias("obs"))


@register("drop_evidence",
          "SELECT event_id, replace(p, e, '[evidence omitted]') AS prompt FROM (SELECT event_id, "
          "'rows of user ' || CAST(user_id AS VARCHAR) AS e, 'Q: ' || event_type || chr(10) || 'Evidence:' || chr(10) "
          "|| 'rows of user ' || CAST(user_id AS VARCHAR) || chr(10) || 'A:' AS p FROM events)")
def drop_evidence(spark, sf_dir):
    """The evidence block replaced by a placeholder after round one."""
    e = X.load(spark, sf_dir, "events")
    ev = F.concat(F.lit("rows of user "), F.col("user_id").cast("string"))
    p = F.concat(F.lit("Q: "), F.col("event_type"), F.lit("\nEvidence:\n"), ev, F.lit("\nA:"))
    return e.select("event_id", P.drop_evidence(p, ev).alias("prompt"))


@register("answer_record",
          f"""WITH p AS {SQL_PARSED}, c AS (SELECT event_id, user_id, ok,
  CASE WHEN ok THEN json_extract_string(j, '$.table_source') END AS src FROM p)
SELECT event_id, src AS table_source,
  CASE WHEN regexp_matches(src, '^df[1-5]$') THEN 'T' || CAST((user_id + CAST(substr(src, 3) AS INTEGER)) % 7 AS VARCHAR) END
    AS selected_table_id,
  CASE WHEN regexp_matches(src, '^df[1-5]$') THEN CAST(substr(src, 3) AS DOUBLE) END AS selected_rank,
  coalesce(CASE WHEN regexp_matches(src, '^df[1-5]$') THEN 'T' || CAST((user_id + CAST(substr(src, 3) AS INTEGER)) % 7
    AS VARCHAR) END = 'T' || CAST((user_id + 2) % 7 AS VARCHAR), false) AS selected_is_gold,
  true AS gold_in_candidates FROM c""")
def answer_record(spark, sf_dir):
    """L6 J6 SC23: parsed answer -> selected alias -> table via the candidate map -> flags."""
    r = replies(spark, sf_dir).withColumn("p", P.parse_final(F.col("reply")))
    i = F.sequence(F.lit(1), F.lit(5))
    cmap = F.map_from_entries(F.transform(i, lambda n: F.struct(
        F.concat(F.lit("df"), n.cast("string")),
        F.struct(n.cast("long").alias("rank"),
                 F.concat(F.lit("T"), ((F.col("user_id") + n) % 7).cast("string")).alias("table_id")))))
    gold = F.concat(F.lit("T"), ((F.col("user_id") + 2) % 7).cast("string"))
    sel = F.element_at(cmap, F.col("p.table_source"))
    ids = F.transform(F.map_values(cmap), lambda s: s["table_id"])
    return r.select("event_id", F.col("p.table_source").alias("table_source"),
                    sel["table_id"].alias("selected_table_id"), sel["rank"].cast("double").alias("selected_rank"),
                    F.coalesce(sel["table_id"] == gold, F.lit(False)).alias("selected_is_gold"),
                    F.array_contains(ids, gold).alias("gold_in_candidates"))


@register("token_count",
          "SELECT conv_id, turn, role, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS BIGINT) AS n_tokens "
          "FROM conversations")
def token_count(spark, sf_dir):
    """SC17: default token counter over every whole conversation turn."""
    from ..functions.text import token_count as tc
    c = X.load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", tc(F.col("text")).cast("long").alias("n_tokens"))
