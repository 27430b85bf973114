"""Query of the importance resampling and its DuckDB twin."""

from __future__ import annotations

from . import resample
from .common import table


def query(spark, sf_dir):
    drawn = resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
w AS (SELECT row, unnest(ws) AS w FROM d),
x AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM w UNION SELECT w FROM e)),
y AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM x, tab),
s AS (SELECT bucket, count(*)::DOUBLE AS n FROM w JOIN y USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS n FROM e JOIN y USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + 10000)
             / ((s.n + 1) * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
k AS (SELECT row, sum(gain)::BIGINT AS weight FROM w JOIN y USING (w) JOIN g USING (bucket) GROUP BY row),
r AS (SELECT d.row, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM d LEFT JOIN k USING (row)),
f AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
             count(*) OVER (PARTITION BY n_features >= 20) * 10 // 100 AS places FROM f)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= places THEN place END AS rank FROM o
"""
