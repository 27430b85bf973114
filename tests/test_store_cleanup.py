"""A written table leaves no shuffle files behind, and the session as it was."""

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from tabsleuth.sources import store


def _shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)

    def write(i):
        return store.materialize(spark.range(1000).repartition(3, "id").withColumn("i", F.lit(i)), "cleaned")
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(write, range(4)))
    assert "spark.sql.classic.shuffleDependency.fileCleanup.enabled" not in spark.conf.getAll
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.5)
    assert not _shuffle_files(spark) - before
    assert [t.count() for t in tables] == [1000] * 4
