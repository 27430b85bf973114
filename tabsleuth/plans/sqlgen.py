"""DuckDB SQL generators for the oracle side of retrieval queries."""

from __future__ import annotations

from ..functions.text import sql_tokenize


def sql_bm25_scores(docs: str, queries: str, keys: list[str], analyzer: str = "word",
                    pinned: bool = True) -> str:
    """(keys..., corpus_id, doc_ord, score) for docs(corpus_id, doc_ord, page_content)
    and queries(keys..., [corpus_id,] query)."""
    k = ", ".join(keys)
    qcols = f"{k}, corpus_id" if pinned else k
    on = "corpus_id, token" if pinned else "token"
    return f"""(WITH d AS (SELECT corpus_id, doc_ord, page_content FROM {docs}),
dt AS (SELECT corpus_id, doc_ord, {sql_tokenize('page_content', analyzer)} AS toks FROM d),
dl AS (SELECT corpus_id, doc_ord, len(toks) AS dl FROM dt),
st AS (SELECT corpus_id, count(*) AS n_docs, avg(dl) AS avgdl FROM dl GROUP BY corpus_id),
tf AS (SELECT corpus_id, doc_ord, token, count(*) AS tf FROM
       (SELECT corpus_id, doc_ord, unnest(toks) AS token FROM dt) GROUP BY corpus_id, doc_ord, token),
dfr AS (SELECT corpus_id, token, count(*) AS df FROM tf GROUP BY corpus_id, token),
raw AS (SELECT dfr.corpus_id, token, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf_raw
        FROM dfr JOIN st USING (corpus_id)),
ai AS (SELECT corpus_id, avg(idf_raw) AS avg_idf FROM raw GROUP BY corpus_id),
idf AS (SELECT raw.corpus_id, token, CASE WHEN idf_raw < 0 THEN 0.25 * avg_idf ELSE idf_raw END AS idf
        FROM raw JOIN ai USING (corpus_id)),
post AS (SELECT tf.corpus_id, tf.token, tf.doc_ord, tf.tf, dl.dl / st.avgdl AS norm, idf.idf
         FROM tf JOIN dl USING (corpus_id, doc_ord) JOIN st USING (corpus_id) JOIN idf USING (corpus_id, token)),
qt AS (SELECT {qcols}, token, count(*) AS qtf FROM
       (SELECT {qcols}, unnest({sql_tokenize('query', analyzer)}) AS token FROM {queries})
       GROUP BY {qcols}, token)
SELECT {k}, post.corpus_id AS corpus_id, doc_ord,
       sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * norm))) AS score
FROM qt JOIN post USING ({on}) GROUP BY {k}, post.corpus_id, doc_ord)"""


def sql_bm25_idf(docs: str, analyzer: str = "word") -> str:
    return f"""(WITH dt AS (SELECT corpus_id, doc_ord, {sql_tokenize('page_content', analyzer)} AS toks FROM {docs}),
st AS (SELECT corpus_id, count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dt GROUP BY corpus_id),
dfr AS (SELECT corpus_id, token, count(DISTINCT doc_ord) AS df FROM
        (SELECT corpus_id, doc_ord, unnest(toks) AS token FROM dt) GROUP BY corpus_id, token),
raw AS (SELECT dfr.corpus_id, token, df, n_docs, avgdl, ln(n_docs - df + 0.5) - ln(df + 0.5) AS idf_raw
        FROM dfr JOIN st USING (corpus_id)),
ai AS (SELECT corpus_id, avg(idf_raw) AS avg_idf FROM raw GROUP BY corpus_id)
SELECT raw.corpus_id AS corpus_id, token, df, n_docs, avgdl,
       CASE WHEN idf_raw < 0 THEN 0.25 * avg_idf ELSE idf_raw END AS idf FROM raw JOIN ai USING (corpus_id))"""


def sql_top_k(scores: str, keys: list[str], k: int, score: str = "score", doc: str = "doc_ord") -> str:
    part = ", ".join(keys)
    return (f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round({score}, 9) DESC, "
            f"{doc} DESC) AS rank FROM {scores}) WHERE rank <= {k})")


def sql_hashed_weights(rows: str, keys: list[str], text: str, dim: int) -> str:
    """(keys..., bucket, w): unit vectors of hashed bags of words."""
    k = ", ".join(keys)
    return f"""(SELECT {k}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {k})) AS w FROM (
  SELECT {k}, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % {dim} AS bucket, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {k}, unnest({sql_tokenize(text)}) AS token FROM {rows}) GROUP BY ALL))"""


def sql_nearest(queries: str, docs: str, q_keys: list[str], dim: int, k: int) -> str:
    """(q_keys..., corpus_id, doc_ord, dist, rank): the k nearest docs(corpus_id, doc_ord, page_content) of
    queries(q_keys..., corpus_id, query) by squared L2 between hashed unit vectors."""
    q, qq = ", ".join(q_keys), ", ".join(f"q.{c}" for c in q_keys)
    same = " AND ".join(f"s.{c} = q.{c}" for c in [*q_keys])
    return f"""(WITH qw AS {sql_hashed_weights(queries, [*q_keys, 'corpus_id'], 'query', dim)},
dw AS {sql_hashed_weights(docs, ['corpus_id', 'doc_ord'], 'page_content', dim)},
qn AS (SELECT {q}, corpus_id, CASE WHEN len({sql_tokenize('query')}) > 0 THEN 1.0 ELSE 0.0 END AS n FROM {queries}),
dn AS (SELECT corpus_id, doc_ord, CASE WHEN len({sql_tokenize('page_content')}) > 0 THEN 1.0 ELSE 0.0 END AS n FROM {docs}),
s AS (SELECT {qq}, q.corpus_id, d.doc_ord, sum(q.w * d.w) AS dot FROM qw q JOIN dw d ON q.corpus_id = d.corpus_id AND q.bucket = d.bucket GROUP BY ALL),
a AS (SELECT {qq}, q.corpus_id, d.doc_ord, greatest(q.n + d.n - 2 * coalesce(s.dot, 0), 0) AS dist FROM qn q JOIN dn d ON q.corpus_id = d.corpus_id
      LEFT JOIN s ON {same} AND s.corpus_id = q.corpus_id AND s.doc_ord = d.doc_ord)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {q}, corpus_id ORDER BY round(dist, 9), doc_ord) AS rank FROM a) WHERE rank <= {k})"""
