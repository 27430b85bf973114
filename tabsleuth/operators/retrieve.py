"""Retrieval over many tables at once.

The reference loops question -> candidate table -> query and builds one
index per table.  Here the corpora of all tables are one DataFrame keyed by
``corpus_id = data_type || ':' || table_id``; the queries of all questions
are joined to their candidate tables once, and one BM25 join plus one
windowed top-k answers everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bm25
from .corpus import cell_docs
from .profile import schema_docs


def table_corpora(cells: DataFrame, budget: int | None = None) -> DataFrame:
    """Schema and cell corpora of every table.

    docs(corpus_id, data_type, table_id, doc_ord, page_content, result_text):
    schema docs are matched on the column name and return the JSON profile
    (R8); cell docs are matched and returned as they are (R9).
    """
    c = cell_docs(cells, budget).select(F.lit("cell").alias("data_type"), "table_id", "doc_ord",
                                        "page_content", F.col("page_content").alias("result_text"))
    c = c.withColumn("corpus_id", corpus_key(F.col("data_type"), F.col("table_id")))
    return schema_corpora(cells).unionByName(c)


def schema_corpora(cells: DataFrame) -> DataFrame:
    """The schema corpora of `table_corpora`."""
    s = schema_docs(cells).select(F.lit("schema").alias("data_type"), "table_id", "doc_ord",
                                  "page_content", "result_text")
    return s.withColumn("corpus_id", corpus_key(F.col("data_type"), F.col("table_id")))


def persist_index(docs: DataFrame, analyzer: str = "word") -> dict[str, DataFrame]:
    """K6: BM25 index written to the shared folder, postings clustered by
    (corpus_id, token) so a lookup reads few row groups."""
    from ..sources.store import materialize
    idx = bm25.build_index(docs, analyzer)
    return {"postings": materialize(idx["postings"], "postings", sort_within=["corpus_id", "token"]),
            "docs": materialize(idx["docs"], "doclen"),
            "idf": materialize(idx["idf"], "idf"), "stats": idx["stats"]}


def corpus_key(data_type: Column, table_id: Column) -> Column:
    return F.concat(data_type, F.lit(":"), table_id)


def pin_queries(queries: DataFrame, candidates: DataFrame, keys: Sequence[str],
                data_types: Sequence[str] = ("schema", "cell")) -> DataFrame:
    """Attach each question's queries to each of its candidate tables.

    queries(question keys..., query_pos, query, [kind]) x candidates(question
    keys..., table_id): the join is on the question key, so its size is
    queries x candidate_k, never questions x all tables.  ``kind`` selects
    the corpus a query runs against (column queries -> schema, cell
    queries -> cell); without it every query runs against every kind.
    """
    kinds = F.array(*[F.lit(t) for t in data_types])
    q = queries if "kind" in queries.columns else queries.withColumn("kind", F.explode(kinds))
    q = q.withColumn("kind", F.when(F.col("kind") == "column", "schema").otherwise(F.col("kind")))
    q = q.where(F.col("kind").isin(*data_types))
    return (q.join(candidates.select(*keys, "table_id"), list(keys))
            .withColumn("corpus_id", corpus_key(F.col("kind"), F.col("table_id"))))


def retrieve(queries: DataFrame, candidates: DataFrame, docs: DataFrame, keys: Sequence[str],
             k: int = 5, analyzer: str = "word", data_types: Sequence[str] = ("schema", "cell"),
             index: dict | None = None, pad: bool = False, mode: str = "bm25",
             embed_fn=None, dim: int = 256, weights: Sequence[float] = (0.5, 0.5)) -> DataFrame:
    """Top-k documents per (question, query, candidate table, kind).

    ``mode`` is ``bm25``, ``embed`` (exact L2 over ``embed_fn`` vectors) or
    ``hybrid`` (weighted reciprocal-rank fusion of embed and bm25, in that
    order, returning the fused union).  Returns keys..., query_pos,
    table_id, data_type, rank, doc_ord, score, page_content, result_text.
    """
    pinned = pin_queries(queries, candidates, keys, data_types)
    qkeys = [*keys, "query_pos", "table_id", "kind"]
    lists = []
    if mode in ("embed", "hybrid"):
        lists.append(_dense_lists(pinned, docs, qkeys, k, embed_fn, dim))
    if mode in ("bm25", "hybrid"):
        index = index or bm25.build_index(docs, analyzer)
        if pad:
            top = bm25.top_k_padded(bm25.score(pinned, index, qkeys, analyzer=analyzer), pinned, index, qkeys, k)
        else:
            top = bm25.search(pinned, index, qkeys, k, analyzer=analyzer)
        lists.append(top)
    if not lists:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    if mode == "hybrid":
        from .fusion import rrf
        top = rrf(lists, [*qkeys, "corpus_id"], "doc_ord", list(weights)).withColumnRenamed("rrf", "score")
    else:
        top = lists[0]
    return (top.join(docs.select("corpus_id", "doc_ord", "page_content", "result_text"),
                     ["corpus_id", "doc_ord"])
            .withColumnRenamed("kind", "data_type").drop("corpus_id"))


def _dense_lists(pinned: DataFrame, docs: DataFrame, qkeys: Sequence[str], k: int, embed_fn, dim: int) -> DataFrame:
    """R5 R6 for pinned queries: every query against its own corpus."""
    from . import dense
    q = pinned.withColumn("_qid", F.to_json(F.struct(*qkeys)))
    qv = dense.embed(q.select("_qid", "corpus_id", "query").distinct(), "query", embed_fn, dim)
    dv = dense.embed(docs.select("corpus_id", "doc_ord", "page_content"), "page_content", embed_fn, dim)
    top = dense.dense_top_k(qv.select("_qid", "corpus_id", "vec"), dv.select("doc_ord", "corpus_id", "vec"),
                            k, "_qid", "doc_ord")
    back = q.select("_qid", *qkeys).distinct()
    return top.join(back, "_qid").select(*qkeys, "corpus_id", "doc_ord", F.col("dist").alias("score"), "rank")


#: Which corpora a mode of retrieval searches, and with which queries: the expanded ones or the question itself.
MODES = {"full": {"schema": "expanded", "cell": "expanded"}, "no_schema": {"cell": "expanded"}, "no_cell": {"schema": "expanded"},
         "no_schema_expansion": {"schema": "question", "cell": "expanded"}, "no_expansion": {"schema": "question", "cell": "question"}}


def mode_queries(mode: str, questions: DataFrame, expanded: DataFrame, keys: Sequence[str], text_col: str = "question") -> DataFrame:
    """The queries (keys..., query, query_pos, kind) of a mode.  ``expanded`` has keys..., query, query_pos
    and may have kind (else each query searches both corpora)."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}")
    parts = []
    for kind, source in MODES[mode].items():
        if source == "question":
            q = questions.select(*keys, F.col(text_col).alias("query"), F.lit(0).cast("long").alias("query_pos"))
        else:
            q = expanded
            if "kind" in q.columns:
                q = q.where(F.when(F.col("kind") == "column", "schema").otherwise(F.col("kind")) == kind)
            q = q.select(*keys, "query", F.col("query_pos").cast("long").alias("query_pos"))
        parts.append(q.withColumn("kind", F.lit(kind)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def union_ordered(hits: DataFrame, keys: Sequence[str], doc: str = "result_text") -> DataFrame:
    """Results of all queries in query order, first occurrence kept.

    ``ord`` = position of the document in the concatenated, de-duplicated list.
    """
    g = [*keys, doc]
    first = hits.groupBy(*g).agg(F.min(F.struct("query_pos", "rank")).alias("first"))
    w = Window.partitionBy(*keys).orderBy("first", doc)       # queries at one position: by document
    return first.withColumn("ord", F.row_number().over(w)).drop("first")


def union_set(hits: DataFrame, keys: Sequence[str], doc: str = "result_text") -> DataFrame:
    """The set of retrieved documents."""
    return hits.select(*keys, doc).distinct()


def schema_frame(spark, tables: dict[str, DataFrame], id_col: str = "row_id") -> DataFrame:
    """(table_id, col_id, column_name) from the tables' schemas: metadata
    only, no scan of the data."""
    rows = [(tid, i, c) for tid, df in tables.items()
            for i, c in enumerate([c for c in df.columns if c != id_col])]
    return spark.createDataFrame(rows, "table_id string, col_id long, column_name string")


def table_title_docs(cells: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One document per table, title followed by its column names.

    ``cells`` may be the long cell form or, cheaper, a schema frame
    (table_id, col_id, column_name)."""
    cols = (cells.select("table_id", "col_id", "column_name").distinct()
            .groupBy("table_id")
            .agg(F.sort_array(F.collect_list(F.struct("col_id", "column_name"))).alias("_c")))
    t = cols if titles is None else cols.join(titles, "table_id", "left")
    title = F.col("title") if titles is not None else F.col("table_id")
    return t.select(F.lit("tables").alias("corpus_id"), "table_id",
                    F.concat_ws(" ", title, F.array_join(F.transform("_c", lambda s: s["column_name"]), " "))
                    .alias("page_content"))


def outer_retrieval(questions: DataFrame, table_docs: DataFrame, keys: Sequence[str], k: int,
                    analyzer: str = "word") -> DataFrame:
    """Rank tables for every question; exactly min(k, #tables) candidates.

    Returns keys..., rank, table_id, score (the candidate list, J2/A12 input).
    """
    from .cells import dense_row_ids
    docs = dense_row_ids(table_docs, ["corpus_id", "table_id"], col="doc_ord")
    index = bm25.build_index(docs, analyzer)
    q = questions.select(*keys, F.col("question").alias("query"), F.lit("tables").alias("corpus_id"))
    sc = bm25.score(q, index, list(keys), analyzer=analyzer)
    top = bm25.top_k_padded(sc, q, index, list(keys), k)
    return (top.join(docs.select("corpus_id", "doc_ord", "table_id"), ["corpus_id", "doc_ord"])
            .select(*keys, "rank", "table_id", F.col("score")))


def row_col_sample(queries: DataFrame, wide_cells: DataFrame, row_docs: DataFrame,
                   col_docs: DataFrame, keys: Sequence[str], k: int = 5,
                   analyzer: str = "word") -> DataFrame:
    """The cells at (top-k rows by query) x (top-k columns by query).

    queries(keys..., table_id, query); row_docs / col_docs(table_id, doc_ord,
    page_content).  The slice is two semi-joins of the cells, never a
    product of rows and columns beyond the table itself.
    """
    out = {}
    for name, d in (("row", row_docs), ("col", col_docs)):
        docs = d.withColumn("corpus_id", F.col("table_id"))
        idx = bm25.build_index(docs, analyzer)
        q = queries.withColumn("corpus_id", F.col("table_id"))
        sc = bm25.score(q, idx, list(keys), analyzer=analyzer)
        top = bm25.top_k_padded(sc, q, idx, list(keys), k)
        out[name] = top.select(*keys, F.col("corpus_id").alias("table_id"),
                               F.col("doc_ord").alias(f"{name}_id"))
    return (wide_cells.select("table_id", "row_id", "col_id", "value")
            .join(out["row"], ["table_id", "row_id"])
            .join(out["col"], [*keys, "table_id", "col_id"], "left_semi"))


def build_or_reuse(docs: DataFrame, analyzer: str, root: str) -> DataFrame:
    """K6: persisted BM25 postings keyed by an identity of each corpus
    (analyzer, corpus id, number and hash of its documents).  Only
    corpora whose identity is not yet under ``root`` are built (left anti
    join); the rest is reused.  Returns (corpus_id, index_id, built, n_postings)."""
    from pyspark.sql.utils import AnalysisException
    spark = docs.sparkSession
    content = F.xxhash64("doc_ord", "page_content").cast("decimal(20,0)")
    ident = (docs.groupBy("corpus_id")
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(content).alias("_content"))
             .select("corpus_id", F.sha2(F.concat_ws("|", F.lit("bm25-v2"), F.lit(analyzer), "corpus_id",
                                                     F.col("_n").cast("string"), F.col("_content").cast("string")),
                                         256).alias("index_id")))
    try:
        existing = spark.read.parquet(root).select("index_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = spark.createDataFrame([], "index_id string")
    missing = ident.join(existing, "index_id", "left_anti")
    # one row per corpus: a corpus stays spread over the tasks that hold its documents and postings
    todo = docs.join(F.broadcast(missing), "corpus_id", "left_semi")
    if not missing.isEmpty():
        idx = bm25.build_index(todo, analyzer)
        (idx["postings"].join(F.broadcast(missing), "corpus_id").write.mode("append")
         .partitionBy("index_id").parquet(root))
    built = missing.select("index_id", F.lit(True).alias("built"))
    stored = spark.read.parquet(root).groupBy("index_id").agg(F.count(F.lit(1)).alias("n_postings"))
    return (ident.join(built, "index_id", "left").join(stored, "index_id", "left")
            .select("corpus_id", "index_id", F.coalesce("built", F.lit(False)).alias("built"), "n_postings"))
