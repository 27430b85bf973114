"""Registered queries: dataframe actions as text, and their observations (L4, F10, SC14, SC18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import cells as C
from . import fixtures as X
from .registry import register

ALIASES = {"df1": "customer", "df2": "part", "df3": "orders", "df4": "nation"}


def _listed(column, source, order):
    """DuckDB text of a Python list of texts."""
    return f"(SELECT '[' || coalesce(string_agg('''' || {column} || '''', ', ' ORDER BY {order}), '') || ']' FROM {source})"


def _counted(key, source, order):
    """DuckDB text of a Python mapping of texts to counts."""
    return (f"(SELECT '{{' || string_agg('''' || {key} || ''': ' || n, ', ' ORDER BY {order}) || '}}' FROM "
            f"(SELECT {key}, count(*) AS n, min(pos) AS pos FROM {source} GROUP BY {key}))")


def _sum(x):
    return f"CAST(coalesce(CAST(sum(CAST({x} AS DECIMAL(38,10))) AS DOUBLE), 0.0) AS VARCHAR)"


_C = "(SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer)"
_M = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders JOIN customer ON o_custkey = c_custkey)"
_MERGE = "m = df3.merge(df1, left_on='o_custkey', right_on='c_custkey')\n"

#: Actions and the SQL of their answers.
LITERAL = [
    ("df1[df1['c_acctbal'] > 3000]['c_name'].nunique()", "SELECT CAST(count(DISTINCT c_name) AS VARCHAR) FROM customer WHERE c_acctbal > 3000"),
    ("df1.shape", "SELECT '(' || count(*) || ', 5)' FROM customer"),
    ("len(df3)", "SELECT CAST(count(*) AS VARCHAR) FROM orders"),
    ("df1['c_acctbal'].max() > df2['p_retailprice'].max()", "SELECT CASE WHEN (SELECT max(c_acctbal) FROM customer) > (SELECT max(p_retailprice) FROM part) THEN 'True' ELSE 'False' END"),
    ("df1[(df1['c_mktsegment'] == 'BUILDING') | ~(df1['c_acctbal'] > 0)]['c_custkey'].sum()",
     "SELECT CAST(CAST(sum(c_custkey) AS BIGINT) AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT c_acctbal > 0"),
    ("df1.sort_values(['c_mktsegment', 'c_acctbal'], ascending=[True, False]).head(4)['c_name'].tolist()",
     f"SELECT {_listed('c_name', '(SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 4)', 'c_mktsegment, c_acctbal DESC, c_custkey')}"),
    ("df1.nlargest(2, 'c_acctbal')['c_name'].tolist()",
     f"SELECT {_listed('c_name', '(SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 2)', 'c_acctbal DESC, c_custkey')}"),
    ("df1['c_mktsegment'].value_counts().to_dict()", f"SELECT {_counted('c_mktsegment', _C, 'n DESC, pos')}"),
    ("df1.groupby('c_mktsegment')['c_acctbal'].count()", f"SELECT {_counted('c_mktsegment', _C, 'c_mktsegment')}"),
    ("df1.groupby('c_mktsegment')['c_custkey'].max().idxmax()", "SELECT arg_max(c_mktsegment, c_custkey) FROM customer"),
    ("df1.groupby('c_mktsegment').size().max()", "SELECT CAST(max(n) AS VARCHAR) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)"),
    ("df1['c_mktsegment'].unique()", f"SELECT {_listed('c_mktsegment', f'(SELECT c_mktsegment, min(pos) AS pos FROM {_C} GROUP BY 1)', 'pos')}"),
    ("df1.drop_duplicates('c_mktsegment')['c_name'].tolist()",
     f"SELECT {_listed('c_name', f'(SELECT arg_min(c_name, pos) AS c_name, min(pos) AS pos FROM {_C} GROUP BY c_mktsegment)', 'pos')}"),
    ("df2[df2['p_name'].str.contains('RED|ring', case=False)]['p_size'].max()", "SELECT CAST(max(p_size) AS VARCHAR) FROM part WHERE regexp_matches(p_name, '(?i)red|ring')"),
    ("df2[df2['p_brand'].isin(['Brand#1', 'Brand#12'])].shape[0]", "SELECT CAST(count(*) AS VARCHAR) FROM part WHERE p_brand IN ('Brand#1', 'Brand#12')"),
    ("df3[df3['o_orderdate'] >= '1995-03-01']['o_orderkey'].count()", "SELECT CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01'"),
    (_MERGE + "m['c_mktsegment'].value_counts()", f"SELECT {_counted('c_mktsegment', _M, 'n DESC, pos')}"),
    (_MERGE + "m[m['c_acctbal'] > 5000]['o_totalprice'].max()", "SELECT CAST(max(o_totalprice) AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"),
    ("df1[df1['c_nationkey'].isin(df4[df4['n_name'].str.startswith('NATION_1')]['n_nationkey'])]['c_name'].nunique()",
     "SELECT CAST(count(DISTINCT c_name) AS VARCHAR) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION_1%')"),
    ("df1[~df1['c_custkey'].isin(df3['o_custkey'])].shape[0]", "SELECT CAST(count(*) AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    ("rich = df1[df1['c_acctbal'] > df1['c_acctbal'].mean()]\nlen(rich)",
     "SELECT CAST(count(*) AS VARCHAR) FROM customer WHERE c_acctbal > (SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(38,10))) AS DOUBLE) / count(c_acctbal) FROM customer)"),
    ("df1[df1['c_acctbal'] == df1['c_acctbal'].max()]['c_name'].iloc[0]", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1"),
    ("df1['c_acctbal'].median()", "SELECT CAST(median(c_acctbal) AS VARCHAR) FROM customer"),
    ("df1.query(\"c_acctbal < 0 and c_mktsegment == 'MACHINERY'\")['c_custkey'].nunique()",
     "SELECT CAST(count(*) AS VARCHAR) FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'"),
    ("(df1['c_acctbal'] < 0).any()", "SELECT CASE WHEN bool_or(c_acctbal < 0) THEN 'True' ELSE 'False' END FROM customer"),
    ("x = df1['c_custkey'].max()", "SELECT 'success!'"),
    ("df1['Age'].mean()", "SELECT 'KeyError: ''Age'''"),
    ("df9['c_name'].nunique()", "SELECT 'NameError: name ''df9'' is not defined'"),
    ("df1[df1['c_name'].apply(len) > 3]", "SELECT 'NotImplementedError: .apply()'"),
    ("df1[", "SELECT 'SyntaxError: invalid syntax'"),
    ("df1[df1['c_custkey'] < 0]['c_name'].iloc[0]", "SELECT 'IndexError: index out of bounds'"),
    (None, "SELECT 'Error: no action found.'"),
]


def actions_frame(spark, sf_dir):
    """The literal actions, and one for every nation, part type and order priority."""
    literal = spark.createDataFrame([(f"lit{i}", a) for i, (a, _) in enumerate(LITERAL)], "program_id string, action string")
    n = X.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("v"))
    t = X.load(spark, sf_dir, "part").select(F.col("p_type").alias("v")).distinct()
    p = X.load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v")).distinct()

    def family(df, name, before, after):
        return df.select(F.concat(F.lit(name), F.col("v")).alias("program_id"), F.concat(F.lit(before), F.col("v"), F.lit(after)).alias("action"))
    parts = [family(n, "bal", "df1[df1['c_nationkey'] == ", "]['c_acctbal'].sum()"),
             family(t, "dear", "df2[(df2['p_type'] == '", "') & (df2['p_size'] > 20)].sort_values('p_retailprice', ascending=False).head(2)['p_name'].tolist()"),
             family(p, "who", _MERGE + "m[m['o_orderpriority'] == '", "']['c_name'].nunique()")]
    out = literal
    for x in parts:
        out = out.unionByName(x)
    return out


def _frames(spark, programs, cells):
    alias = F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(t).alias("table_id")) for a, t in ALIASES.items()])).alias("a")
    return A.frames_of(programs.select("program_id", alias).select("program_id", "a.*"), cells)


SQL_ACTIONS = "\nUNION ALL ".join(f"SELECT 'lit{i}' AS program_id, ({q}) AS answer" for i, (_, q) in enumerate(LITERAL)) + f"""
UNION ALL SELECT 'bal' || n_nationkey, {_sum('c_acctbal')} FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
UNION ALL SELECT 'dear' || t, '[' || coalesce(string_agg('''' || p_name || '''', ', ' ORDER BY r) FILTER (r <= 2), '') || ']'
  FROM (SELECT DISTINCT p_type AS t FROM part) LEFT JOIN
       (SELECT p_type, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size > 20) ON p_type = t GROUP BY t
UNION ALL SELECT 'who' || o_orderpriority, CAST(count(DISTINCT c_name) AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_orderpriority"""


@register("table_actions", SQL_ACTIONS)
def table_actions(spark, sf_dir):
    """L4: action texts over df1..df4, compiled and answered for all programs at once."""
    tables = X.star_tables(spark, sf_dir, list(ALIASES.values()))
    cells = C.cells_of(tables)
    programs = actions_frame(spark, sf_dir)
    return A.run_actions(programs, _frames(spark, programs, cells), cells, rows=C.rows_of(tables)).select("program_id", "answer")


LIMIT = 60
_NAMES = "(SELECT n_nationkey AS n, '[' || coalesce(string_agg('''' || c_name || '''', ', ' ORDER BY c_custkey), '') || ']' AS l FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"


@register("action_observations", f"""SELECT n AS program_id, CASE WHEN n % 5 = 0 THEN 'Error: no action found.'
  WHEN len(regexp_extract_all(l, '\\w+|[^\\w\\s]')) > {LIMIT} THEN 'Observation is too long, we cannot query the API.' ELSE l END AS observation FROM {_NAMES}""")
def action_observations(spark, sf_dir):
    """F10, SC14, SC18: the code of each reply is evaluated; long observations are guarded."""
    tables = X.star_tables(spark, sf_dir, list(ALIASES.values()))
    cells = C.cells_of(tables)
    n = F.col("n_nationkey").cast("string")
    code = F.concat(F.lit("df1[df1['c_nationkey'] == "), n, F.lit("]['c_name'].tolist()"))
    k = F.col("n_nationkey") % 5
    reply = (F.when(k == 0, F.lit("Thought: nothing to run.")).when(k == 1, F.concat(F.lit("Thought: x\nAction: ```python\n"), code, F.lit("\n```")))
             .when(k == 2, F.concat(F.lit("Action: `"), code, F.lit("`"))).when(k == 3, F.concat(F.lit("Action: no\nAction: \""), code, F.lit("\"")))
             .otherwise(F.concat(F.lit("Action: "), code)))
    replies = X.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("program_id"), reply.alias("reply"))
    return A.observe(replies, _frames(spark, replies, cells), cells, LIMIT, rows=C.rows_of(tables))
