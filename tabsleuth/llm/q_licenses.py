"""Query of the license scan and its DuckDB twin, which compares every block with every template."""

from __future__ import annotations

from . import licenses
from .common import table


def query(spark, sf_dir):
    return licenses.label(table(spark, sf_dir, "documents"))


def _values(rows):
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows)


_TEMPLATES = [(k, label, " ".join(words), need, stride) for label, k, words, need, stride in licenses.prepared().itertuples(index=False)]

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT string_split(phrase, ' ') AS ps, label FROM (VALUES {_values(licenses.PHRASES.items())}) v(phrase, label)),
t AS (SELECT template, label, string_split(words, ' ') AS ts, need, stride FROM (VALUES {_values(_TEMPLATES)}) v(template, label, words, need, stride)),
i AS (SELECT row, ws, unnest(range(len(ws))) AS pos FROM d),
b AS (SELECT row, pos, label FROM i JOIN p ON ws[pos + 1] = ps[1] AND ws[pos + 1:pos + len(ps)] = ps),
n AS (SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
      FROM b GROUP BY row),
k AS (SELECT row, pos, stride, list_distinct(ws[pos + 1:pos + 2 * stride]) AS block
      FROM i JOIN (SELECT DISTINCT stride FROM t) ON pos % stride = 0),
m AS (SELECT row, label, len(list_intersect(block, ts)) / len(ts) AS share
      FROM k JOIN t ON t.stride = k.stride WHERE len(list_intersect(block, ts)) >= need),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM b UNION SELECT row, label FROM m) GROUP BY row),
h AS (SELECT row, max(share) AS share FROM m GROUP BY row)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (row) LEFT JOIN a USING (row) LEFT JOIN h USING (row)
"""
