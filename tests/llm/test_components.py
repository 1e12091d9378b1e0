import time

import pytest
from pyspark.sql import functions as F

from sparkcorpus.llm import common


def test_components_settle_or_fail(spark):
    path = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in common.connected_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.connected_components(path, most=1)


def test_steps_leave_no_shuffle_files(spark):
    """Their tables are read again in few tasks, so that a shuffle after them writes few files."""
    def shuffles() -> int:
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return blocks.count("shuffle_")

    before = shuffles()
    rows = common.materialize(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and rows.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
    assert common.settled(spark.range(1000, numPartitions=9)).rdd.getNumPartitions() == 1
    assert common.settled(spark.range(1000, numPartitions=9), 200).rdd.getNumPartitions() == 5
