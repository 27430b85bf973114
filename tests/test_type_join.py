"""The join of cells with the types of their columns."""

from pyspark.sql import functions as F

from tabsleuth.operators import cells as C

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def test_cells_of_a_large_column_stay_in_place(spark):
    rows = spark.range(20000).select(F.concat(F.lit("t"), F.col("id") % 2).alias("table_id"), F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("col_id"),
                                     F.lit("n").alias("column_name"),
                                     F.col("id").cast("string").alias("value"))
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "32768")
    try:
        typed = C.apply_types(rows, C.infer_types(rows))
        plan = typed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert typed.where("dtype = 'int64' and num = row_id").count() == 20000
    finally:
        spark.conf.set(LIMIT, before)
