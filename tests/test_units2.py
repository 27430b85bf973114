"""Hand-computed cases for parsing, expansion, programs and candidates."""

from pyspark.sql import functions as F


def test_parse_final_shapes(spark):
    from tabsleuth.functions import answers as A
    from tabsleuth.functions import parse as P
    cases = [
        ('Thought: x\nFinal Answer: {"table_source": "df2", "answer": 11.0}', True, "df2", "11.0"),
        ('```json\n{"table_source": "df1", "answer": "abc"}\n```', True, "df1", "abc"),
        ("Thought: {'table_source': 'df3', 'answer': True}", True, "df3", "True"),
        ('Final Answer: {"table_source": "df1", "answer": [1, "a"]}', True, "df1", '[1, "a"]'),
        ("Final Answer: not json", False, None, None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "r string").withColumn("p", P.parse_final(F.col("r")))
    got = df.select(F.col("p.ok"), F.col("p.table_source"),
                    F.when(F.col("p.ok"), A.format_answer(F.col("p.answer"), F.col("p.answer_raw")))).collect()
    for (r, ok, src, ans), g in zip(cases, got):
        assert (g[0], g[1], g[2]) == (ok, src, ans), r


def test_action_and_stop(spark):
    from tabsleuth.functions import parse as P
    df = spark.createDataFrame([("Action: ```python\ndf1.x.sum()\n```\nObservation: 3",),
                                ("Thought: a\nAction: `df2.y.max()`",), ("no action",)], "r string")
    got = df.select(P.parse_action(F.col("r")), P.stop_cut(F.col("r"))).collect()
    assert [g[0] for g in got] == ["df1.x.sum()", "df2.y.max()", None]
    assert got[0][1] == "Action: ```python\ndf1.x.sum()\n```\n"


def test_programs_hand_case(spark):
    from tabsleuth.operators.cells import cells_of
    from tabsleuth.operators.programs import evaluate
    t = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, "b", 5.0)],
                              "row_id long, k string, v double")
    cells = cells_of({"t": t})
    progs = spark.createDataFrame(
        [("p1", "t", "k", "a", "mean", "v"), ("p2", "t", "k", "b", "count", "v"), ("p3", "t", None, None, "mode", "v"),
         ("p4", "t", "k", "zz", "count", "v")],
        "program_id string, table_id string, filter_col string, filter_value string, agg string, target_col string")
    got = {r["program_id"]: r["answer"] for r in evaluate(progs, cells).collect()}
    assert got == {"p1": "2", "p2": "2", "p3": "5.0", "p4": "0"}


def test_candidate_shapes(spark):
    from tabsleuth.operators import candidates as CD
    recs = spark.createDataFrame(
        [(1, '["A", ["B", 0.5], {"table_name": "C", "rank": 7, "caption": "cc"}, "A"]'),
         (2, '{"query_index": 2, "results": [{"id": "D", "score": 1}]}')], "q long, record string")
    n = CD.normalize_candidates(CD.explode_records(recs, "record", ["q"]), ["q"])
    rows = sorted((r["q"], r["position"], r["rank"], r["table_id"], r["title"], r["score"]) for r in n.collect())
    assert rows == [(1, 1, 1, "A", "A", None), (1, 2, 2, "B", "B", 0.5), (1, 3, 7, "C", "cc", None),
                    (1, 4, 4, "A", "A", None), (2, 1, 1, "D", "D", 1.0)]
    d = CD.dedupe(n, ["q"])
    assert d.count() == 4


def test_expansion_contains_values(spark):
    from tabsleuth.operators.cells import cells_of
    from tabsleuth.operators.expand import builtin_expand
    t = spark.createDataFrame([(0, "New York", 5), (1, "Paris", 7)], "row_id long, city_name string, pop long")
    q = spark.createDataFrame([(1, "Which city_name is New York, not 42?")], "question_id long, question string")
    got = {(r["kind"], r["query"]) for r in builtin_expand(q, cells_of({"t": t}), ["question_id"]).collect()}
    assert ("cell", "new york") in got and ("column", "city_name") in got
    assert not any(k == "cell" and v == "42" for k, v in got)


def test_shared_search_equals_scoring_every_query(spark):
    """Rare and frequent tokens, queries of equal and of no known tokens, two texts under one key: the rows of a plain join."""
    import random
    from tabsleuth.operators import bm25
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(c, i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randrange(0, 9)))) for c in "ab" for i in range(120)]
    queries = [(i % 70, c, " ".join(rng.choices([*words, "unknown"], k=rng.randrange(0, 5)))) for i in range(90) for c in "abz"]
    d = spark.createDataFrame(docs, "corpus_id string, doc_ord long, page_content string")
    q = spark.createDataFrame(queries + queries[:6], "question_id long, corpus_id string, query string")
    index = bm25.build_index(d)

    def rows(df):
        return sorted((r["question_id"], r["corpus_id"], r["doc_ord"], r["rank"], round(r["score"], 9)) for r in df.collect())
    want = rows(bm25.top_k(bm25.score(q, index, ["question_id"]), ["question_id", "corpus_id"], 3))
    for rare in (0, 5, 25, 1000):
        assert rows(bm25.search(q, index, ["question_id"], 3, rare_docs=rare)) == want


def test_least_of_each_row():
    import numpy as np
    from tabsleuth.operators.dense import _least
    x = np.round(np.random.default_rng(2).random((30, 50)), 1)
    x[3, :48] = np.nan
    for k in (1, 4, 50, 60):
        rows, cols = _least(x, k)
        best = np.argsort(x, axis=1, kind="stable")[:, :k]
        assert rows.tolist() == np.repeat(np.arange(30), best.shape[1]).tolist() and cols.tolist() == best.reshape(-1).tolist()
