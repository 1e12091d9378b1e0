"""Large corpora and runs aren't gathered into one row."""

from pyspark.sql import functions as F

from sparkcorpus.functions.text import fingerprint
from sparkcorpus.operators import chunksets, history


def tables(spark, n=300):
    docs = spark.range(n).select(F.concat(F.lit('d"'), "id").alias("id"), F.when(F.col("id") % 3 > 0, F.lit("big")).when(F.col("id") % 2 > 0, F.lit('a"documents":[]')).alias("corpus_id"), (F.col("id") % 7).alias("uploaded_at"))
    return docs, docs.select(F.col("id").alias("document_id"), F.concat(F.lit("p"), "id").alias("parse_id"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flat_fingerprint(spark):
    docs, parses = tables(spark)
    pairs = docs.withColumnRenamed("id", "document_id").join(parses, "document_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("uploaded_at", "document_id", "parse_id"))), lambda x: F.struct(x["document_id"].alias("document_id"), x["parse_id"].alias("parse_id")))
    want = pairs.groupBy("corpus_id").agg(listed.alias("documents")).select("corpus_id", fingerprint(F.struct(F.lit(32000).alias("cap"), F.lit("x").alias("chunker"), F.lit(chunksets.VERSION).alias("chunker_version"), F.lit("c").alias("config"), "corpus_id", "documents", F.lit("t").alias("tokenizer"))))
    got = chunksets.chunk_set_fingerprints(docs, parses, "c", "x", "t")
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect())) and "collect_list" not in plan(got)


def test_tree_fingerprint(spark):
    docs, parses = tables(spark)
    prints = lambda d, p: dict(map(tuple, chunksets.chunk_set_tree_fingerprints(d, p, "c", "x", "t").collect()))
    first = prints(docs, parses)
    assert len(first) == 3 and prints(docs.repartition(7), parses.repartition(3)) == first
    assert [k for k, v in prints(docs, parses.withColumn("parse_id", F.when(F.col("document_id") == 'd"1', "q").otherwise(F.col("parse_id")))).items() if v != first[k]] == ["big"]
    assert [k for k, v in prints(docs.withColumn("uploaded_at", F.when(F.col("id") == 'd"2', 99).otherwise(F.col("uploaded_at"))), parses).items() if v != first[k]] == ["big"]


def test_run_detail_is_flat(spark):
    runs = spark.createDataFrame([("r", "done"), ("s", "pending")], "id string, status string")
    examples = spark.createDataFrame([("r", f"e{i}", i, "completed") for i in (2, 0, 1)], "run_id string, example_run_id string, ordinal int, status string")
    hits = spark.createDataFrame([("e1", 2, "y", "n", 0, 1), ("e1", 1, "x", "n", 0, 1)], "example_run_id string, rank int, chunk_id string, document_name string, start int, end int")
    got = history.run_detail(runs, examples, hits).collect()
    assert [(r.id, r.status, r.ordinal, [h.chunk_id for h in r.hits or []]) for r in got] == [("r", "done", 0, []), ("r", "done", 1, ["x", "y"]), ("r", "done", 2, []), ("s", "pending", None, [])]
