"""The build of a vector index, stopped and resumed, and artifacts that two writers want."""

import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkcorpus.operators import indexing, vectors
from sparkcorpus.operators.indexing import Embedded
from sparkcorpus.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
SET = {"id": "s", "fingerprint": "f"}


def chunks_of(spark, n=300):
    return spark.createDataFrame([(f"c{i:04d}", f"text {i}") for i in range(n)], "chunk_id string, text string")


def numbered(texts):
    return [[float(t.split()[-1]), 1.0] for t in texts]


def calls_of(spark, folder):
    """An embedder that leaves a line for each text in a file of its own, so that calls in workers that die count too."""
    import os

    os.makedirs(folder)

    def embed(texts, fail=None):
        import uuid

        if fail is not None and any(t.endswith(fail) for t in texts):
            raise RuntimeError("stopped")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(texts))
        return numbered(texts)

    def called():
        return [t for name in os.listdir(folder) for t in open(f"{folder}/{name}").read().split("\n")]

    return embed, called


def test_a_stopped_build_goes_on_and_embeds_no_text_twice(spark, tmp_path):
    chunks, path = chunks_of(spark), f"file://{tmp_path}/indexes"
    embed, called = calls_of(spark, f"{tmp_path}/calls")
    build = lambda e: indexing.build_vector_index(chunks, SET, e, path, commit_chunks=16, range_chunks=64)
    with pytest.raises(Exception, match="stopped"):
        build(lambda texts: embed(texts, fail=" 277"))
    assert files.read_manifest(spark, path) is None  # nobody sees it
    half = called()
    stored = {r.chunk_id for f in spark._jvm.java.io.File(f"{tmp_path}/indexes/collections").listFiles() for r in indexing.read_vectors(spark, f"file://{f.getPath()}").collect()}
    assert 0 < len(stored) < 300
    row, again = build(embed)
    assert not again and row["vector_count"] == "300" and row["dimensions"] == "2"
    assert [(r.chunk_id, r.embedding) for r in indexing.read_vectors(spark, row["collection_name"]).orderBy("chunk_id").collect()] == [
        (f"c{i:04d}", [float(i), 1.0]) for i in range(300)]
    later = called()
    first = {f"text {i}" for i in range(indexing.BATCH)}  # the live first batch of each run
    for i in range(300):
        text = f"text {i}"
        if f"c{i:04d}" in stored:
            assert later.count(text) == half.count(text) + (text in first)
        if text in first:
            assert later.count(text) == 2  # once for each run, and not in tasks
    assert build(embed)[1] and len(called()) == len(later) + indexing.BATCH


def test_reuse_needs_the_same_space(spark, tmp_path):
    chunks, path = chunks_of(spark, 40), f"file://{tmp_path}"
    build = lambda e, **more: indexing.build_vector_index(chunks, SET, e, path, **more)
    one, again = build(lambda t: Embedded(numbered(t), "m", "1"))
    assert not again and build(lambda t: Embedded(numbered(t), "m", "1")) == (one, True)
    others = [build(lambda t: Embedded(numbered(t), "m", "2")), build(lambda t: [[*v, 0.0] for v in numbered(t)]), build(numbered, metric="euclidean"),
        build(numbered, model="other"), indexing.build_vector_index(chunks, {"id": "s", "fingerprint": "g"}, numbered, path)]
    assert not any(again for _, again in others) and len({r["artifact_id"] for r, _ in others} | {one["artifact_id"]}) == 6
    assert files.read_manifest(spark, path).count() == 6


@pytest.mark.parametrize("bad", ["width", "finite", "few", "revision", "empty"])
def test_vectors_of_another_space_are_refused(spark, tmp_path, bad):
    """The first batch is good; a later one isn't."""

    def embed(texts):
        good = numbered(texts)
        if "text 39" not in texts:
            return Embedded(good, "m", "1")
        return {"width": [[1.0]] * len(good), "finite": [[1.0, float("nan")]] * len(good), "few": good[1:], "empty": [[]] * len(good),
            "revision": Embedded(good, "m", "2")}[bad]

    with pytest.raises(Exception, match="InvalidEmbedding"):
        indexing.build_vector_index(chunks_of(spark, 40), SET, embed, f"file://{tmp_path}")
    assert files.read_manifest(spark, f"file://{tmp_path}") is None


def test_nothing_to_index_and_repeated_chunks(spark, tmp_path):
    with pytest.raises(indexing.EmptyChunkSet):
        indexing.build_vector_index(chunks_of(spark, 0), SET, numbered, f"file://{tmp_path}")
    with pytest.raises(RuntimeError, match="vectors of"):
        indexing.build_vector_index(chunks_of(spark, 3).union(chunks_of(spark, 1)), SET, numbered, f"file://{tmp_path}")


def test_metadata_and_prefix(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(sum(t.startswith("search_document: ") for t in texts))
        return numbered(texts)

    meta = vectors.vector_metadata(required={"chunk": F.col("chunk_id")}, optional={"page_start": F.lit(None).cast("int")})
    row, _ = indexing.build_vector_index(chunks_of(spark, 2), SET, embed, f"file://{tmp_path}", model="Nomic-Embed-Text-x", metadata=meta)
    assert [r.metadata for r in indexing.read_vectors(spark, row["collection_name"]).orderBy("chunk_id").collect()] == ['{"chunk":"c0000"}', '{"chunk":"c0001"}']
    assert seen.value == 2  # the first batch isn't embedded again


def test_two_writers_leave_one_artifact_whole(spark, tmp_path):
    path, results = str(tmp_path), []
    one, two = spark.range(100).select("id", F.lit("one").alias("w")), spark.range(300).select("id", F.lit("two").alias("w"))
    writers = [threading.Thread(target=lambda df=df: results.append(files.write_artifact(df, path, "a", {"fingerprint": "f"}))) for df in (one, two)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(results) == [False, True]
    rows = files.read_artifacts(spark, path)
    assert rows.groupBy("w", "artifact_id").count().collect() in ([("one", "a", 100)], [("two", "a", 300)])
    assert files.read_manifest(spark, path).count() == 1


def test_an_id_has_one_fingerprint(spark, tmp_path):
    path = str(tmp_path)
    assert files.write_artifact(spark.range(5), path, "a", {"fingerprint": "f"})
    with pytest.raises(ValueError, match="another fingerprint"):
        files.write_artifact(spark.range(9), path, "a", {"fingerprint": "g"})
    assert not files.write_artifact(spark.range(9), path, "b", {"fingerprint": "f"})
    assert files.read_artifacts(spark, path).count() == 5
    assert files.write_artifact(spark.range(7), path, "c", {"fingerprint": "h", "note": "more columns"})
    assert sorted(map(tuple, files.read_artifacts(spark, path).groupBy("artifact_id").count().collect())) == [("a", 5), ("c", 7)]
    plan = files.read_artifacts(spark, path).where("artifact_id = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()  # only the folder of that attempt is read
