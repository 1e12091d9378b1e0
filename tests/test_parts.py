import json
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus.functions import text
from sparkcorpus.operators import chunksets, evaluation, history, questions, search, vectors
from sparkcorpus.sources import files


def test_strip_like_python(spark):
    values = [" a ", "　a b ", "\x1ca\n", "", "\t\n", "a"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(text.strip(F.col("v"))).collect()
    assert [r[0] for r in rows] == [v.strip() for v in values]


def test_uuid5_like_python(spark):
    names = ["", "a", "chunk:é:1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.uuid5(chunksets.SET_NAMESPACE, F.col("n"))).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(uuid.UUID(chunksets.SET_NAMESPACE), n)) for n in names]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é\r\nx\ry".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "c.txt").write_bytes(b"a\x00b")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("[Content_Types].xml", "")
        z.writestr("word/document.xml", "")
    (tmp_path / "e.docx").write_bytes(b"PK nothing")
    read = files.read_documents(spark, str(tmp_path), "c")
    coded = files.admit_files(read, content_ok=files.content_matches_format(F.col("content"), F.col("extension")))
    assert {r.original_filename: r.reject_code for r in coded.collect()} == {"a.md": None, "b.pdf": None, "c.txt": "invalid_file_content", "d.docx": None, "e.docx": "invalid_file_content"}
    assert {r.original_filename: r.text for r in files.read_text_documents(spark, str(tmp_path)).collect()}["a.md"] == "é\nx\ny"


def test_question_sets(spark, tmp_path):
    good = {"examples": [{"question": "q", "relevant_documents": ["a"]}, {"question": "q"}]}
    for name, value in (("good", good), ("empty", {"examples": []}), ("unknown", {"examples": [{"question": "q", "x": 1}]}), ("top", {"examples": [{"question": "q"}], "y": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "broken.json").write_text("{")
    rows = files.read_question_sets(spark, str(tmp_path)).collect()
    assert {r.file: r.error for r in rows if r.error} == {"empty.json": "no_examples", "unknown.json": "unknown_field", "top.json": "unknown_field", "broken.json": "bad_json"}
    assert [(r.ordinal, r.question) for r in rows if r.file == "good.json"] == [(0, "q"), (1, "q")]


def test_artifact_is_written_once(spark, tmp_path):
    df = spark.range(5)
    assert files.write_artifact(df, str(tmp_path), "a1", {"fingerprint": "f"})
    assert not files.write_artifact(df, str(tmp_path), "a2", {"fingerprint": "f"})
    df.write.parquet(f"{tmp_path}/rows/attempt=broken")
    assert files.read_artifacts(spark, str(tmp_path)).count() == 5


@pytest.mark.parametrize("metric", search.METRICS)
def test_top_k_against_brute_force(spark, metric):
    random = np.random.default_rng(1)
    x = random.integers(-2, 3, (200, 4)).astype(float)
    x[7] = 0
    rows = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").repartition(5)
    queries = rows.where("chunk_id < '020'").withColumnRenamed("chunk_id", "query_id")
    found = {}
    for r in search.top_k(queries, rows, 6, metric, block=7).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.raw_distance
    for q in range(20):
        d = np.sort(search.distances(x[q : q + 1], x, metric)[0])[:6]
        assert np.allclose([found[f"{q:03d}"][k] for k in range(1, 7)], d)


def test_top_k_edges(spark):
    none = spark.createDataFrame([], "chunk_id string, embedding array<double>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert search.top_k(query, none, 3).count() == 0
    assert search.top_k(query.limit(0), none, 3).count() == 0
    with pytest.raises(ValueError):
        search.top_k(query, none, 0)


def test_scores(spark):
    labels = spark.createDataFrame([("q", "a"), ("q", "b"), ("z", "a")], "example_id string, document_id string")
    hits = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "a"), ("q", 4, "b")], "example_id string, rank int, document_id string")
    asked = spark.createDataFrame([("q",), ("z",), ("u",)], "example_id string")
    scores = evaluation.score_retrieval(asked, labels, hits, 3)
    assert {r.example_id: tuple(r)[1:4] for r in scores.collect()} == {"q": (1.0, 0.5, 0.5), "z": (0.0, 0.0, 0.0), "u": (None, None, None)}
    assert evaluation.retrieval_evidence(asked, labels, hits, 3).where("example_id = 'q'").first().matching_ranks == [2, 3]


def test_embedding_in_batches(spark):
    sizes = []

    def embedder(texts):
        assert len(texts) <= 4
        return [[float(len(t))] for t in texts]

    rows = vectors.embed(spark.createDataFrame([("x" * i,) for i in range(1, 11)], "text string"), embedder, 4).collect()
    assert all(r.embedding == [len(r.text)] for r in rows) and not sizes


def test_unknown_usage_is_not_zero(spark):
    runs = spark.createDataFrame([("r", 1)], "id string, created_at int")
    rows = spark.createDataFrame([("r", "completed", 1.0, None, None, 0, 3), ("r", "failed", None, None, None, None, None)], "run_id string, status string, retrieval_ms double, generation_ms double, prompt_tokens int, completion_tokens int, total_tokens int")
    r = history.run_summary(runs, rows).first()
    assert (r.prompt_tokens, r.known_prompt_tokens, r.completion_tokens, r.known_completion_tokens, r.failed_examples, r.retrieval_results) == (None, 0, 0, 1, 1, 1)


def test_labels(spark):
    docs = spark.createDataFrame([("1", "c", "a"), ("2", "c", "b"), ("3", "c", "b")], "id string, corpus_id string, original_filename string")
    examples = spark.createDataFrame([("e", "c", [" a ", "a", "b", "", "zz"])], "example_id string, corpus_id string, relevant_documents array<string>")
    assert [tuple(r) for r in questions.resolve_labels(examples, docs).collect()] == [("e", "1", 0)]
    assert sorted((r.position, r.code) for r in questions.label_warnings(examples, docs).collect()) == [(2, "ambiguous_document_name"), (3, "document_not_found"), (4, "document_not_found")]


def test_export(spark, tmp_path):
    files.export_runs(spark.createDataFrame([("b", 2), ("a", None)], "id string, n int"), str(tmp_path / "out"))
    assert [r.id for r in spark.read.json(str(tmp_path / "out")).orderBy("id").collect()] == ["a", "b"]
