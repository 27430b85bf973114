"""Literal cases for answers, replies, templates, candidates, retrieval and indexes."""

import math

import pytest
from pyspark.sql import functions as F

from tabsleuth.functions import answers as A
from tabsleuth.functions import parse as P
from tabsleuth.operators import bm25 as B
from tabsleuth.operators import candidates as CD
from tabsleuth.operators import evidence as EV
from tabsleuth.operators import expand as XP
from tabsleuth.operators import programs as PG
from tabsleuth.operators import retrieve as R
from tabsleuth.operators.cells import cells_of
from tabsleuth.session import ship_package
from tabsleuth.sources import files as FS


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def _column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_numbers_of_any_size(spark):
    cases = {"1e20": "100000000000000000000", "1e400": "1e400", "12345678901234567": "12345678901234567",
             "-007": "-7", "+5": "5", "-0": "0", "9" * 40: "9" * 40, "1_000": "1000", "2.0000001": "2"}
    assert _column(spark, cases, A.normalize_answer) == list(cases.values())


def test_json_lists_keep_apostrophes(spark):
    cases = {'["O\'Brien, Pat", "x"]': "o'brien, pat|x", "['b', 'a']": "a|b", "[not a list": "[not a list", '["a", "a"]': "a"}
    assert _column(spark, cases, A.normalize_answer) == list(cases.values())


def test_literal_final_answers(spark):
    texts = ["Thought: {'table_source': 'df1', 'answer': \"it's\"}", "Final Answer: {'table_source': 'df2', 'answer': 'say \"hi\"'}",
             "Thought: {'table_source': 'df3', 'answer': None}", 'Final Answer: {"table_source": "df4", "answer": "True"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", P.parse_final(F.col("t")))
    got = df.select("i", "p.ok", "p.table_source", A.format_answer(F.col("p.answer"), F.col("p.answer_raw"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(True, "df1", "it's"), (True, "df2", 'say "hi"'), (True, "df3", ""), (True, "df4", "True")]


def test_template_values_are_not_fields(spark):
    df = spark.createDataFrame([("what is {ev} and {q}?", "{q} é $1 \\2", None)], "q string, ev string, n int")
    got = df.select(P.fill_template(F.lit("{{a}} {q} | {ev} | {n} {q}"), {"q": F.col("q"), "ev": F.col("ev"), "n": F.col("n")})).first()[0]
    assert got == "{a} what is {ev} and {q}? | {q} é $1 \\2 | None what is {ev} and {q}?"
    assert df.select(P.fill_template(F.lit("no fields {{}}"), {"q": F.col("q")})).first()[0] == "no fields {}"


def test_alias_is_the_place_and_queries_are_by_kind(spark):
    union = spark.createDataFrame([(1, "tA", "schema", 1, "sA"), (1, "tB", "cell", 1, "cB")],
                                  "q int, table_id string, data_type string, ord int, result_text string")
    queries = spark.createDataFrame([(1, 0, "col", "column"), (1, 1, "val", "cell")], "q int, query_pos int, query string, kind string")
    cands = spark.createDataFrame([(1, 1, "tA", "First"), (1, 3, "tB", None)], "q int, rank int, table_id string, title string")
    r = EV.evidence(union, queries, cands, ["q"]).first()
    assert r.candidate_map == "df1: table_id=tA | title=First\ndf2: table_id=tB | title=tB"
    assert "Candidate df2 | rank=3 | table_id=tB" in r.evidence
    assert r.evidence.count("Schema Retrieval Queries: col\n") == 2 and r.evidence.count("Cell Retrieval Queries: val\n") == 2
    m = EV.docs_maps(union, cands, ["q"]).first()
    assert m.retrieved_columns == {"df1": ["sA"]} and m.retrieved_cells == {"df2": ["cB"]}


def test_envelopes_and_missing_records(spark):
    files = ['[{"tables": ["A"]}, {"tables": ["B"]}]', '{"results": [{"tables": ["C"]}]}', '{"data": [["D", "E"]]}', '{"tables": ["F"]}',
             '{"results": [{"id": "G"}]}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(files)], "f int, j string")
    rec = CD.explode_envelopes(df, "j", ["f"])
    n = CD.normalize_candidates(CD.explode_records(rec, "record", ["f", "record_no"]), ["f", "record_no"])
    got = sorted((r.f, r.record_no, r.position, r.table_id) for r in n.collect())
    assert got == [(0, 0, 1, "A"), (0, 1, 1, "B"), (1, 0, 1, "C"), (2, 0, 1, "D"), (2, 0, 2, "E"), (3, 0, 1, "F"), (4, 0, 1, "G")]
    for bad in ("[]", '{"tables": []}', '{"other": 1}'):
        one = spark.createDataFrame([(bad,)], "j string")
        with pytest.raises(Exception, match="without candidates"):
            CD.explode_records(one, "j", []).collect()
    with pytest.raises(Exception, match="no retrieval records"):
        CD.explode_envelopes(spark.createDataFrame([("[]",)], "j string"), "j").collect()


def test_column_queries_search_the_schema(spark):
    q = spark.createDataFrame([(1, 0, "price", "column"), (1, 1, "red", "cell")], "q int, query_pos int, query string, kind string")
    c = spark.createDataFrame([(1, "t")], "q int, table_id string")
    got = sorted((r["query"], r["kind"], r["corpus_id"]) for r in R.pin_queries(q, c, ["q"]).collect())
    assert got == [("price", "schema", "schema:t"), ("red", "cell", "cell:t")]


def test_padding_with_negative_scores(spark):
    texts = ["a b", "a b", "c"]
    docs = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "corpus_id string, doc_ord long, page_content string")
    q = spark.createDataFrame([(1, "t", "a")], "q int, corpus_id string, query string")
    idx = B.build_index(docs, "word")
    score = {r.doc_ord: r.score for r in B.score(q, idx, ["q"]).collect()}
    score = {i: score.get(i, 0.0) for i in range(3)}
    want = sorted(range(3), key=lambda i: (-round(score[i], 9), -i))
    for k in (1, 2, 3, 4, 9):
        got = B.top_k_padded(B.score(q, idx, ["q"]), q, idx, ["q"], k).orderBy("rank").collect()
        assert [r.doc_ord for r in got] == want[:k]
        assert all(math.isclose(r.score, score[r.doc_ord], abs_tol=1e-12) for r in got)
    assert min(score.values()) < 0


def test_programs_count_values_and_unknown_fails(spark):
    t = spark.createDataFrame([(0, "a", 1.0), (1, "a", None), (2, "a", 3.0)], "row_id long, k string, v double")
    schema = "program_id string, table_id string, filter_col string, filter_value string, agg string, target_col string"
    cells = cells_of({"t": t})
    got = PG.evaluate(spark.createDataFrame([("p", "t", "k", "a", "count", "v")], schema), cells).first()
    assert got.answer == "2"
    with pytest.raises(Exception, match="unknown aggregate"):
        PG.evaluate(spark.createDataFrame([("p", "t", "k", "a", "median", "v")], schema), cells).collect()


def test_expansion_finds_long_values(spark):
    t = spark.createDataFrame([(0, "United States of America", 1), (1, "UK", 2)], "row_id long, name string, id long")
    q = spark.createDataFrame([(1, "What is the id of United States of America or UK?")], "question_id long, question string")
    got = {(r["kind"], r["query"]) for r in XP.builtin_expand(q, cells_of({"t": t}), ["question_id"]).collect()}
    assert {("cell", "united states of america"), ("cell", "uk"), ("column", "id")} <= got


def test_catalog_ids(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "sales" / "all.parquet"))
    df.repartition(2).write.parquet(str(tmp_path / "people.parquet"))
    single = tmp_path / "flat"
    df.coalesce(1).write.parquet(str(single))
    next(single.glob("part-*.parquet")).rename(tmp_path / "places.parquet")
    cat = FS.table_catalog(spark, str(tmp_path))
    ids = [r.table_id for r in cat.orderBy("position").collect()]
    assert "people" in ids and "places" in ids and len(ids) == len(set(ids))


def test_package_reaches_workers(spark):
    got = spark.createDataFrame([("é",)], "t string").select(A.normalize(F.col("t"))).first()[0]
    assert got == "e"


def test_missing_record_fails(spark):
    q = spark.createDataFrame([(1,), (2,)], "q int")
    r = spark.createDataFrame([(1, '["A"]')], "q int, record string")
    assert CD.with_records(q, r, ["q"], strict=False).count() == 1
    with pytest.raises(Exception, match="no retrieval record for question 2"):
        CD.with_records(q, r, ["q"]).collect()


def test_dense_ties_and_dimensions(spark):
    from tabsleuth.operators.dense import dense_top_k
    d = spark.createDataFrame([(i, "c", [1.0, 0.0]) for i in range(6)] + [(9, "c", [1.0, 0.1]), (10, "x", [1.0, 0.0]), (11, "c", [1.0])],
                              "doc_id long, corpus_id string, vec array<double>")
    q = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "none", [1.0, 0.0])], "query_id long, corpus_id string, vec array<double>")
    got = [(r.query_id, r.rank, r.doc_id, round(r.dist, 9)) for r in dense_top_k(q, d, 3).orderBy("rank").collect()]
    assert got == [(1, 1, 0, 0.0), (1, 2, 1, 0.0), (1, 3, 2, 0.0)]


def test_missing_ids_of_an_aggregate(spark):
    from pyspark.sql import functions as F

    from tabsleuth.operators import evaluate as E
    present = spark.createDataFrame([(0,), (2,), (5,)], "ord long")
    assert sorted(r.ord for r in E.missing_ids(present, F.max("ord") + 1).collect()) == [1, 3, 4]
    assert sorted(r.ord for r in E.missing_ids(present, 4).collect()) == [1, 3]
    assert E.missing_ids(present.limit(0), F.max("ord") + 1).count() == 0
