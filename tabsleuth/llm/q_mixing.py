"""Query of the mixing operator and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing
from .common import table


def query(spark, sf_dir):
    m = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_quality(table(spark, sf_dir, "labels")))
    m = m.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return m.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part_words")).alias("taken"))


SQL = r"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 1.0 ELSE 0.25 END) AS w FROM labels
           WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS size,
             -ln((('0x' || substr(md5('mix-1:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
             / coalesce(q.w, 0.5) AS draw
      FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1.0 AS w FROM s),
c AS (SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS ratio FROM n),
l AS (SELECT a.source, (SELECT sum(source_size) FROM c) AS total,
             coalesce((SELECT sum(cap) FROM c b WHERE (b.ratio, coalesce(b.source, chr(1114111))) < (a.ratio, coalesce(a.source, chr(1114111)))), 0) AS used,
             (SELECT sum(b.w) FROM c b WHERE (b.ratio, coalesce(b.source, chr(1114111))) >= (a.ratio, coalesce(a.source, chr(1114111)))) AS open,
             a.w, a.cap, a.ratio, a.source_size FROM c a),
k AS (SELECT *, (total - used) / open AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE
             ELSE w * (SELECT min(level) FROM k WHERE ratio > level AND ratio = (SELECT min(ratio) FROM k WHERE ratio > level)) END::DOUBLE AS target FROM k),
p AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto,
             CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * e + greatest(0, least(size, floor(target - e * source_size)::BIGINT - (upto - size))))::BIGINT AS taken
FROM p
"""
