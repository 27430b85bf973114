"""A record is parsed once, and an order's lines meet once."""

from pyspark.sql import functions as F

from tabsleuth.operators import candidates as CD
from tabsleuth.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_a_record_is_parsed_once(spark):
    recs = spark.createDataFrame([(1, '{"tables": ["a", ["b", 0.5], {"id": "c", "rank": 9, "score": 1, "caption": "C"}]}'),
                                  (2, '[["d", "x"], {"table": "e"}]')], "q long, record string")
    n = CD.normalize_candidates(CD.explode_records(recs, "record", ["q"]), ["q"])
    assert [tuple(r) for r in n.orderBy("q", "position").collect()[:3]] == [
        (1, 1, 1, "a", "a", None, None, None), (1, 2, 2, "b", "b", 0.5, None, None), (1, 3, 9, "c", "C", 1.0, None, None)]
    assert [tuple(r) for r in n.where("q = 2").orderBy("position").collect()] == [
        (2, 1, 1, "d", "d", None, None, None), (2, 2, 2, "e", "e", None, None, None)]
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_lines_of_an_order_are_shuffled_once(spark):
    df = X.retrieval_records(spark, SF)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert "ordinals" not in plan
    # the rank that a record states is the place of the line
    r = df.select(F.explode(F.regexp_extract_all("record", F.lit(r'"rank": (\d+)'))).alias("n")).agg(F.min(F.col("n").cast("int")), F.max(F.col("n").cast("int"))).first()
    most = X.load(spark, SF, "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    assert r[0] == 1 and r[1] <= most
