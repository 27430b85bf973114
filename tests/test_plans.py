"""Plan invariants over every registered query (sf0.001)."""

import pytest

SF = "/root/testdata/sf0.001"

# Queries whose only join keys fold to constants (a single table or corpus,
# or the three-row template dimension): the remaining nested-loop joins
# broadcast one to three rows.
SMALL_CONSTANT_JOINS = {"context_by_baseline", "context_guard", "outer_table_retrieval", "prompt_fill", "prompt_guard",
                        "random_sample", "row_col_sample", "context_random"}


def _names():
    from tabsleuth.plans.all import QUERIES
    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_no_cartesian_or_row_udf(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan          # no row-at-a-time Python UDFs
    if name not in SMALL_CONSTANT_JOINS:
        assert "BroadcastNestedLoopJoin" not in plan
