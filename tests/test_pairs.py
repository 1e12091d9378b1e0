"""Pairs of one large key are made by many tasks."""

from pyspark.sql import functions as F

from sparkcorpus.operators import history, pairs


def tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_launchable_pairs_of_one_corpus(spark, monkeypatch):
    monkeypatch.setattr(pairs.matched, "__defaults__", (None, 16))
    indexes = spark.range(100).select("id", F.lit(7).alias("corpus_id"), F.lit("ready").alias("status"), F.when(F.col("id") % 2 > 0, F.lit("v")).alias("vector_index_id"))
    got = history.compatible_inputs(indexes, spark.range(90).select("id", F.lit(7).alias("corpus_id")))
    assert sorted(map(tuple, got.collect())) == [(i, d, i % 2 > 0, None if i % 2 else "no_vector_index") for i in range(100) for d in range(90)]
    assert tasks(got) > 8


def test_runs_of_one_dataset(spark, monkeypatch):
    monkeypatch.setattr(pairs.matched, "__defaults__", (None, 16))
    examples = spark.range(90).select(F.lit("d").alias("dataset_id"), F.col("id").alias("example_id"), F.col("id").alias("ordinal"))
    got = history.expand_runs(spark.range(100).select("id", F.lit("d").alias("dataset_id")), examples)
    assert sorted(map(tuple, got.collect())) == [(r, e, e, "pending", 90) for r in range(100) for e in range(90)]
    assert tasks(got) > 8


def test_odd_keys(spark):
    """Null keys, keys of one side, equal rows, null values, and names that the join could take for its own."""
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b"), (None, "c")], "k int, n string")
    right = spark.createDataFrame([(1, 5, "p")] * 40 + [(3, 6, "q"), (None, 7, "r")], "k int, l int, x string")
    for part in (1, 3, 4096):
        got = pairs.matched(left, right, "k", n_right="of", part=part)
        assert got.columns == ["k", "n", "l", "x", "of"]
        assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k").withColumn("of", F.lit(40)).collect()))
    assert pairs.matched(left, right.limit(0), "k").count() == 0
