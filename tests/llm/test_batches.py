"""Texts go to Python in batches of bounded size, whatever the number of rows."""

import uuid

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from sparkcorpus.llm import common, decontamination, similar, token_files

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("module", [decontamination, similar, token_files], ids=lambda m: m.__name__.rpartition(".")[2])
def test_batches_are_bounded(spark, tmp_path, monkeypatch, module):
    folder, real = str(tmp_path), common.slices

    def noted(batches, *rest):
        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}.bytes", "w") as f:
                f.write(str(b.nbytes))
            yield from real(iter([b]), *rest)

    monkeypatch.setattr(module, "slices", noted)
    docs = spark.range(1500, numPartitions=1).select(F.col("id").alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1300)), lambda i: F.concat(F.lit("w"), i * 7919 % 997 + F.col("id") * 1000)), " ").alias("text"))
    docs = common.written(docs.coalesce(1), "long-texts")
    if module is decontamination:
        items = spark.createDataFrame([(1, " ".join(f"w{i * 7919 % 997 + 5000}" for i in range(1, 41)))], "item_id long, text string")
        assert [tuple(r) for r in module.leaks(docs, items).select("doc_id", "item_id").collect()] == [(5, 1)]
    elif module is similar:
        assert module.drop_similar(docs.where("doc_id < 1500")).count() == 1500
    else:
        assert module.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, str(tmp_path / "files")).count() == 1500
    sizes = [int(f.read_text()) for f in tmp_path.glob("*.bytes")]
    assert sum(sizes) > 10_000_000 and max(sizes) < 1.5 * common.SLICE_BYTES
    assert spark.conf.get(KEY, None) is None


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(KEY, "12345")
    try:
        with common.bounded_batches(spark):
            assert spark.conf.get(KEY) == "12345"
        assert spark.conf.get(KEY) == "12345"
    finally:
        spark.conf.unset(KEY)
