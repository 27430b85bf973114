"""Registered queries: candidate preparation (S5 S6 SC4 A11 A12 J1-J5 F14 F17 K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as CD
from . import fixtures as X
from .registry import register

N = X.SQL_NORMALIZED_CANDIDATES
DEDUP = f"(SELECT * FROM {N} n WHERE position = (SELECT min(position) FROM {N} m WHERE m.l_orderkey = n.l_orderkey AND m.table_id = n.table_id))"
DEDUP_CTE = (f"WITH n AS {N}, d AS (SELECT n.* FROM n JOIN (SELECT l_orderkey, table_id, min(position) AS position "
             f"FROM n GROUP BY l_orderkey, table_id) f USING (l_orderkey, table_id, position)), "
             f"c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY position) AS cand_pos FROM d), "
             f"g AS {X.SQL_GOLD}")


def normalized(spark, sf_dir):
    """Normalised candidates, written once per application and data folder."""
    from ..sources.store import materialize

    def build():
        recs = X.retrieval_records(spark, sf_dir)
        n = CD.normalize_candidates(CD.explode_records(recs, "record", ["l_orderkey"]), ["l_orderkey"])
        return materialize(n, "candidates-normalized")
    return X.session_memo(spark, ("candidates", sf_dir), build)


@register("candidate_normalize", f"SELECT * FROM {N}")
def candidate_normalize(spark, sf_dir):
    """S5 SC4: mixed-shape retrieval JSON -> one normalised candidate per row."""
    return normalized(spark, sf_dir)


@register("candidate_dedupe",
          DEDUP_CTE + " SELECT l_orderkey, position, rank, table_id, CAST(cand_pos AS BIGINT) AS cand_pos FROM c")
def candidate_dedupe(spark, sf_dir):
    """First occurrence of each table per question, ranks not renumbered."""
    d = CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"])
    return CD.cut_k(d, ["l_orderkey"], 1 << 30).select("l_orderkey", "position", "rank", "table_id", "cand_pos")


@register("gold_rank",
          DEDUP_CTE + """ SELECT g.l_orderkey, g.gold_table_id,
  CAST((SELECT rank FROM c WHERE c.l_orderkey = g.l_orderkey AND c.table_id = g.gold_table_id) AS DOUBLE) AS gold_rank
  FROM g""")
def gold_rank(spark, sf_dir):
    """Rank of the gold table among a question's candidates."""
    d = CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"])
    g = CD.gold_rank(d, X.gold_tables(spark, sf_dir), ["l_orderkey"])
    return g.withColumn("gold_rank", F.col("gold_rank").cast("double"))


@register("recall_at_k",
          DEDUP_CTE + """, gp AS (SELECT g.l_orderkey, (SELECT cand_pos FROM c WHERE c.l_orderkey = g.l_orderkey
     AND c.table_id = g.gold_table_id) AS gold_pos FROM g)
  SELECT CAST(k AS BIGINT) AS k, count(*) AS n, count(gold_pos) AS found,
         round(avg(CASE WHEN gold_pos <= k THEN 1.0 ELSE 0.0 END), 6) AS recall
  FROM gp, (VALUES (1), (2), (3), (5), (10)) ks(k) GROUP BY k""")
def recall_at_k(spark, sf_dir):
    """Recall of the gold table in the first k candidates, all k in one pass."""
    d = CD.cut_k(CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"], 1 << 30)
    g = X.gold_tables(spark, sf_dir)
    gp = (g.join(d, (g.l_orderkey == d.l_orderkey) & (g.gold_table_id == d.table_id), "left")
          .select(g.l_orderkey, d.cand_pos.alias("gold_pos")))
    return CD.recall_at_k(gp, [1, 2, 3, 5, 10]).select("k", "n", "found", F.round("recall", 6).alias("recall"))


@register("gold_membership",
          DEDUP_CTE + """ SELECT g.l_orderkey, coalesce((SELECT bool_or(c.table_id = g.gold_table_id) FROM c
  WHERE c.l_orderkey = g.l_orderkey AND c.cand_pos <= 2), false) AS gold_in_candidates FROM g""")
def gold_membership(spark, sf_dir):
    """Is the gold table among the first 2 candidates."""
    d = CD.cut_k(CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"], 2)
    return CD.membership(d, X.gold_tables(spark, sf_dir), ["l_orderkey"])


@register("candidate_join",
          f"""WITH q AS (SELECT o_orderkey AS l_orderkey, 'Which supplier shipped the largest line of order '
  || CAST(o_orderkey AS VARCHAR) || '?' AS question, o_orderstatus AS label FROM orders),
r AS {X.SQL_RETRIEVAL_RECORDS}, g AS {X.SQL_GOLD}
SELECT 'databench-' || CAST(q.l_orderkey AS VARCHAR) AS id, q.l_orderkey AS databench_qa_index, question, label,
  gold_table_id, CAST(json_array_length(CASE WHEN json_type(record::JSON) = 'ARRAY' THEN record::JSON ELSE
  coalesce(json_extract(record, '$.top_tables'), json_extract(record, '$.results')) END) AS BIGINT) AS n_candidates
FROM q JOIN r USING (l_orderkey) JOIN g USING (l_orderkey)""")
def candidate_join(spark, sf_dir):
    """Annotated questions joined with retrieval records by question index."""
    o = X.load(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("l_orderkey"),
                 F.concat(F.lit("Which supplier shipped the largest line of order "),
                          F.col("o_orderkey").cast("string"), F.lit("?")).alias("question"),
                 F.col("o_orderstatus").alias("label"))
    r = X.retrieval_records(spark, sf_dir)
    count = CD._once(F.parse_json(F.col("record")), lambda v: F.size(F.from_json(F.to_json(CD.record_candidates(v)), "array<string>")))
    # Orders without lines have no record: here they are left out knowingly.
    j = CD.with_records(q, r, ["l_orderkey"], strict=False).join(X.gold_tables(spark, sf_dir), "l_orderkey")
    return j.select(F.concat(F.lit("databench-"), F.col("l_orderkey").cast("string")).alias("id"),
                    F.col("l_orderkey").alias("databench_qa_index"), "question", "label", "gold_table_id",
                    count.cast("long").alias("n_candidates"))


@register("candidate_jsonl",
          DEDUP_CTE + """, top AS (SELECT * FROM c WHERE cand_pos <= 3)
SELECT 'databench-' || CAST(l_orderkey AS VARCHAR) AS id, CAST(count(*) AS BIGINT) AS n_candidates,
  arg_min(table_id, cand_pos) AS first_table, arg_min(title, cand_pos) AS first_title,
  arg_max(table_id, cand_pos) AS last_table FROM top GROUP BY l_orderkey""")
def candidate_jsonl(spark, sf_dir):
    """K1: one JSON line per question (candidate_k = 3); checked by parsing the lines back."""
    d = CD.cut_k(CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"], 3)
    d = d.withColumn("id", F.concat(F.lit("databench-"), F.col("l_orderkey").cast("string")))
    lines = CD.candidate_record(d, ["id"], ["rank", "table_id", "title", "score", "bm25_score", "dense_score"])
    back = lines.select(F.from_json("json", "id string, candidate_tables array<struct<rank:int, table_id:string, "
                                            "title:string, score:double>>").alias("r")).select("r.*")
    c = F.col("candidate_tables")
    return back.select("id", F.size(c).cast("long").alias("n_candidates"),
                       c[0]["table_id"].alias("first_table"), c[0]["title"].alias("first_title"),
                       F.element_at(c, -1)["table_id"].alias("last_table"))


@register("all_tables_cross",
          "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(r_regionkey + 1 AS BIGINT) AS rank, r_name AS table_id FROM nation, region")
def all_tables_cross(spark, sf_dir):
    """Every nation question against every region 'table' (checked, bounded catalog)."""
    n = X.load(spark, sf_dir, "nation").select("n_nationkey")
    r = X.load(spark, sf_dir, "region")
    cat = r.select(F.col("r_name").alias("table_id"), F.col("r_name").alias("title"),
                   (F.col("r_regionkey") + 1).alias("position"))
    return CD.all_tables(n, cat).select("n_nationkey", "rank", "table_id")


@register("gold_only",
          DEDUP_CTE + " SELECT g.l_orderkey, g.gold_table_id AS table_id, c.rank FROM g JOIN c "
          "ON c.l_orderkey = g.l_orderkey AND c.table_id = g.gold_table_id")
def gold_only(spark, sf_dir):
    """The gold table only, taken from each question's candidates."""
    d = CD.dedupe(normalized(spark, sf_dir), ["l_orderkey"])
    return CD.gold_only(d, X.gold_tables(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "table_id", "rank")


@register("catalog_violations",
          f"SELECT n.l_orderkey, n.table_id FROM {N} n ANTI JOIN supplier s ON 'S' || CAST(s.s_suppkey AS VARCHAR) = n.table_id")
def catalog_violations(spark, sf_dir):
    """candidates naming a table that is not in the catalog (expected: none)."""
    cat = X.load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("table_id"))
    return CD.catalog_violations(normalized(spark, sf_dir), cat).select("l_orderkey", "table_id")
