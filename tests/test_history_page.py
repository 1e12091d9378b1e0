from pyspark.sql import functions as F

from sparkcorpus.operators import history


def test_only_the_page_is_numbered(spark):
    runs = spark.range(45).select(F.format_string("r%02d", "id").alias("id"), *(F.lit("x").alias(c) for c in ("index_id", "index_name", "dataset_id", "dataset_name")), F.lit("completed").alias("status"), F.timestamp_seconds("id").alias("created_at"), F.timestamp_seconds("id").alias("started_at"), F.col("id").alias("duration_ms"), F.lit(1).alias("completed_examples"), F.lit(1).alias("total_examples"))
    got = history.run_history(runs, "2026-01-01", page=9)
    assert [(r.id, r.position, r.page) for r in got.orderBy("position").collect()] == [(f"r{4 - i:02d}", 41 + i, 3) for i in range(5)]
    text = history.run_history(runs, "2026-01-01")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window ") == 1 and text.index("Window ") < text.index("GlobalLimit")
    assert history.run_history(runs.where("id = 'none'"), "2026-01-01").count() == 0
