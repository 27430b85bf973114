"""Query of the line dedup and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lines
from .common import table


def query(spark, sf_dir):
    d = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


SQL = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM x),
n AS (SELECT *, lower(trim(line, ' ' || chr(9) || chr(13))) AS s FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM n),
f AS (SELECT *, length(s) AS len FROM o WHERE k = 1 AND length(s) >= 20),
h AS (SELECT doc_id, i, s, u.m, u.half FROM f,
      LATERAL (SELECT unnest([len, len, len - 1, len - 1]) AS m, unnest(['h' || left(s, len // 2), 't' || right(s, len // 2),
               'h' || left(s, (len - 1) // 2), 't' || right(s, (len - 1) // 2)]) AS half) u),
g AS (SELECT DISTINCT b.doc_id, b.i FROM h a JOIN h b ON a.m = b.m AND a.half = b.half AND (a.doc_id, a.i) < (b.doc_id, b.i)
      WHERE levenshtein(a.s, b.s) <= 1),
r AS (SELECT o.*, o.s <> '' AND (o.k > 1 OR g.doc_id IS NOT NULL) AS gone FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.i = o.i)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
