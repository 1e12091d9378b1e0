"""Cases that the test tables never reach."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkcorpus.functions import storage
from sparkcorpus.operators import audit, canonical, chunking, chunksets, context, evaluation, search, vectors
from sparkcorpus.sources import files

ODD = ["a　b c\x1cd", "x\x85y", " lead and trail ", "one two", "", None, "　"]


def one_column(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")


def test_tokens_and_their_number_agree(spark):
    rows = chunking.token_offsets(one_column(spark, ODD)).withColumn("n", chunking.token_count(F.col("text"))).collect()
    assert [(r.n, len(r.token_starts)) for r in sorted(rows)] == [(n, n) for n in (len((t or "").split()) for t in ODD)]


def test_page_labels(spark):
    rows = spark.createDataFrame([(12, 12), (12, 13), (None, 3), (4, None), (None, None)], "a int, b int")
    assert [r[0] for r in rows.select(context.page_label(F.col("a"), F.col("b"))).collect()] == ["12", "12-13", "unknown-3", "4-unknown", "unknown-unknown"]


def test_the_first_broken_rule_of_a_parse_counts(spark):
    rows = [
        (" ", "1", "{}", "", "invalid_parser_output"), ("p", "1", "{nope", " \n", "empty_parsed_document"), ("p", "1", "{nope", "x", "invalid_parser_output"),
        ("p", "1", '{"title":"To Infinity and back, NaN"}', "x", None), ("p", "1", '{"a":Infinity}', "x", "invalid_parser_output"), ("p", "1", '{"a":-Infinity}', "x", "invalid_parser_output"),
    ]
    df = spark.createDataFrame(rows, "parser_name string, parser_version string, metadata string, text string, wanted string")
    assert all(r.reject_code == r.wanted for r in canonical.validate_parses(df).collect())


def test_blank_slices_of_a_capped_chunk_go(spark):
    text = "x" * 10 + "　" * 10 + "y"
    chunks = spark.createDataFrame([("d", 0, text, 0, 21, 0, 2)], "document_id string, ordinal int, text string, start long, end long, token_start long, token_end long")
    assert [(r.part, r.text) for r in chunking.enforce_character_cap(chunks, cap=10).orderBy("part").collect()] == [(0, "x" * 10), (2, "y")]


# --- chunks, the slow way ----------------------------------------------------------------------------------------

SENTENCE = r"(?<=[.!?。！？])(?:[ \t]+|\n+|(?=\S))"  # noqa: RUF001


def cut(text, a, z, pattern):
    """Non-blank ranges between the separators."""
    marks = [m.span() for m in re.compile(pattern).finditer(text, a, z)]
    edges = [a, *(x for m in marks for x in m), z]
    return [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if text[x:y].strip()]


def tokens_in(piece, tokens):
    inside = [i for i, (a, z) in enumerate(tokens) if z > piece[0] and a < piece[1]]
    return (inside[0], inside[-1] + 1) if inside else None


def slow_paragraphs(text, size):
    tokens, groups = [m.span() for m in re.finditer(r"\S+", text)], []
    held = None
    for piece in cut(text, 0, len(text), r"\n[^\S\n]*\n+"):
        a, z = tokens_in(piece, tokens)
        if held and z - held[0] <= size:
            held = (held[0], z)
            continue
        if held:
            groups.append(held)
        held = (a, z) if z - a <= size else None
        if held is None:
            groups += [(x, min(x + size, z)) for x in range(a, z, size)]
    return groups + ([held] if held else [])


def slow_stops(text, tokens, a, z, size, level=0):
    if z - a <= size:
        return {z}
    levels = (r"\n[^\S\n]*\n+", SENTENCE, r"\n+", r"\s+")
    if level == len(levels):
        return {*range(a + size, z, size), z}
    parts = [t for p in cut(text, tokens[a][0], tokens[z - 1][1], levels[level]) if (t := tokens_in(p, tokens))]
    if len(parts) <= 1:
        return slow_stops(text, tokens, a, z, size, level + 1)
    return set().union(*(slow_stops(text, tokens, x, y, size, level + 1) for x, y in parts))


def slow_recursive(text, size, overlap):
    tokens, out, a = [m.span() for m in re.finditer(r"\S+", text)], [], 0
    stops = slow_stops(text, tokens, 0, len(tokens), size) if tokens else set()
    while tokens:
        far = min(a + size, len(tokens))
        end = max((s for s in stops if a < s <= far), default=far)
        if end <= a + overlap and far > end:
            end = far
        out.append((a, end))
        if end >= len(tokens):
            break
        a = max(a + 1, end - overlap)
    return out


def test_chunks_are_those_of_the_slow_version(spark):
    pieces = ["ab", "c", " ", "  ", "\n", "\n\n", "\n \n", ". ", "。", "? ", "é", "\t", "　", ".\r", ".　", "x. y"]
    r = random.Random(4)
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(300))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string").repartition(3)
    spans = lambda df: {i: [(c.token_start, c.token_end) for c in df if c.document_id == i] for i in range(len(texts))}
    recursive = spans(chunking.chunk_recursive(docs, 7, 2).orderBy("document_id", "ordinal").collect())
    paragraphs = spans(chunking.chunk_paragraph(docs, 7).orderBy("document_id", "ordinal").collect())
    assert recursive == {i: slow_recursive(t, 7, 2) for i, t in enumerate(texts)}
    assert paragraphs == {i: slow_paragraphs(t, 7) for i, t in enumerate(texts)}


def test_a_no_break_blank_ends_no_sentence():
    assert [m.span() for m in chunking.LEVELS[1].finditer("a.\xa0b. c")] == [(5, 6)] or chunking.LEVELS[1].search("a.\xa0b").span() == (2, 2)


def test_chunk_sets_of_two_strategies_differ_and_unparsed_corpora_wait(spark):
    docs = spark.createDataFrame([("1", "a", "1.md", 1), ("2", "a", "2.md", 2), ("3", "b", "3.md", 3), ("4", "b", "4.md", 4)], "id string, corpus_id string, original_filename string, uploaded_at int")
    parses = spark.createDataFrame([("1", "p1", "x y z"), ("2", "p2", "u v"), ("3", "p3", "w")], "document_id string, parse_id string, text string")
    pages = spark.createDataFrame([], "document_id string, page_number int, start long, end long")
    blocks = spark.createDataFrame([], "document_id string, ordinal int, start long, end long")
    calls = spark.sparkContext.accumulator(0)

    def chunker(d):
        def counted(text):
            calls.add(1)
            return chunking.whitespace_tokens(text)

        return chunking.chunk_fixed(d, 2, 0, tokenizer=counted)

    rows, sets = chunksets.build_chunk_set(docs, parses, pages, blocks, chunker, "c", "fixed")
    assert rows.count() == 3 and {r.corpus_id for r in rows.collect()} == {"a"} and calls.value == 2
    assert {(r.corpus_id, r.status, r.chunk_count) for r in sets.collect()} == {("a", "ready", 3), ("b", "incomplete", 0)}
    other = chunksets.build_chunk_set(docs, parses, pages, blocks, chunker, "c", "other")[1]
    assert {r.chunk_set_id for r in sets.collect()} & {r.chunk_set_id for r in other.collect()} == {None}
    assert "MapInPandas" not in rows._jdf.queryExecution().executedPlan().toString()


# --- indexes and retrieval ---------------------------------------------------------------------------------------


def test_revisions_and_versions_have_prints_of_their_own(spark):
    base = dict(model=F.lit("m"), dimensions=F.lit(3))
    kinds = [{}, {"provider_model": F.lit("x")}, {"provider_revision": F.lit("x")}, {"adapter": ("local", "2")}, {"store": ("table", "2")}]
    prints = spark.range(1).select(*(vectors.vector_index_fingerprint(F.lit("s"), F.lit("f"), **base, **k).alias(str(i)) for i, k in enumerate(kinds))).first()
    assert len(set(prints)) == len(kinds)


INDEX = {"status": "ready", "provider": "p", "model": "m", "distance_metric": "cosine", "input_policy_version": "1", "indexer_name": "n", "indexer_version": "1", "collection_name": "c", "dimensions": 2, "vector_count": 3, "chunk_set_id": "s"}


def retrieved(spark, index=INDEX, k=2, embedder=None, request=None):
    asked = spark.createDataFrame([("q1", " up "), ("q2", "　"), ("q3", "long text"), ("q4", None)], "query_id string, question string").repartition(3)
    own = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "chunk_id string, embedding array<double>")
    chunks = spark.createDataFrame([("a", "s", "A"), ("b", "t", "B"), ("c", "s", "C")], "id string, chunk_set_id string, text string")
    return search.retrieve(asked, index, own, chunks, k, embedder or (lambda texts: [[1.0, 0.5] if len(t) < 5 else [1.0] for t in texts]), request or index)


def test_retrieval(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return [[1.0, 0.5] if len(t) < 5 else [1.0] for t in texts]

    hits, errors = retrieved(spark, embedder=embedder, k=9)
    assert hits.collect() == []  # one of its three chunks is of another set
    assert sorted(map(tuple, errors.collect())) == [("q1", "missing_or_foreign_chunk"), ("q2", "blank_question"), ("q3", "query_width_mismatch"), ("q4", "blank_question")]
    assert calls.value == 2


@pytest.mark.parametrize("change", [{"status": "building"}, {"model": "x"}, {"dimensions": 0}, {"vector_count": 0}, {"collection_name": " "}, {"chunk_set_id": ""}])
def test_an_index_that_does_not_fit_is_refused(spark, change):
    with pytest.raises(ValueError):
        retrieved(spark, INDEX | change, request=INDEX)


def test_k_and_revisions(spark):
    with pytest.raises(ValueError):
        retrieved(spark, k=0)
    with pytest.raises(ValueError, match="provider_revision_mismatch"):
        retrieved(spark, INDEX | {"provider_revision": "1"}, request=INDEX | {"provider_revision": "2"})
    hits, errors = retrieved(spark, INDEX | {"provider_revision": "1"})
    assert [(r.query_id, r["rank"], r.text) for r in hits.orderBy("rank").collect()] == [("q1", 1, "C"), ("q1", 2, "A")]
    assert "q1" not in {r.query_id for r in errors.collect()}


def test_a_question_with_a_wrong_hit_has_no_evidence(spark):
    chunks = spark.createDataFrame([("a", "s", "A", 0), ("b", "t", "B", 0), ("c", "s", "C", 0)], "id string, chunk_set_id string, text string, n int")
    hits = [("fine", 1, "a"), ("fine", 2, "c"), ("foreign", 1, "a"), ("foreign", 2, "b"), ("missing", 1, "x"), ("twice", 1, "a"), ("twice", 2, "a"), ("twice", 3, "c")]
    good, bad = search.hydrate(spark.createDataFrame(hits, "query_id string, rank int, chunk_id string"), chunks, "s")
    assert sorted((r.query_id, r["rank"], r.text, r.n) for r in good.collect()) == [("fine", 1, "A", 0), ("fine", 2, "C", 0)]
    assert sorted(map(tuple, bad.collect())) == [("foreign", 2, "b", "missing_or_foreign_chunk"), ("missing", 1, "x", "missing_or_foreign_chunk"),
        ("twice", 1, "a", "duplicate_chunk"), ("twice", 2, "a", "duplicate_chunk")]


def test_an_index_with_fewer_vectors_than_it_says(spark):
    hits, errors = retrieved(spark, INDEX | {"vector_count": 4}, k=9)
    assert hits.count() == 0 and ("q1", "invalid_hits") in {tuple(r) for r in errors.collect()}


# --- judgments, question sets, artifacts, audits -----------------------------------------------------------------


def test_judgments_are_stripped_and_carry_usage(spark):
    item = {"metric": "groundedness", "score": 3, "rationale": "　why\n", "evidence_ranks": [1]}
    replies = [("a", {"results": [item], "usage": {"prompt_tokens": 4, "completion_tokens": -1, "total_tokens": True}}), ("b", {"results": [item | {"score": True}]}), ("c", {"results": [item | {"evidence_ranks": [2]}]}), ("d", {"results": [item | {"rationale": "　"}]})]
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in replies], "example_id string, reply string")
    requests = rows.select("example_id", F.array(F.lit("groundedness")).alias("metrics"), F.lit(1).alias("context_size"))
    got = {r.example_id: r for r in evaluation.parse_judgments(rows, requests).collect()}
    a = got["a"]
    assert (a.rubric_score, a.score, a.rationale, a.evidence_ranks, a.error) == (3, 0.75, "why", [1], None)
    assert (a.prompt_tokens, a.completion_tokens, a.total_tokens) == (4, None, None)
    assert all(got[k].error == "invalid_evaluator_response" and got[k].score is None for k in "bcd")


def test_types_of_question_sets(spark):
    texts = {"number": {"question": 1}, "null": {"question": None}, "list": {"question": "q", "relevant_documents": None}, "items": {"question": "q", "relevant_documents": [1]}, "answer": {"question": "q", "reference_answer": 2}, "good": {"question": "q", "reference_answer": None, "relevant_documents": []}}
    raw = spark.createDataFrame([(k, 9, json.dumps({"examples": [v]})) for k, v in texts.items()], "file string, length int, text string")
    got = {r.file: r.error for r in files.parse_question_sets(raw).collect()}
    assert got.pop("good") is None and set(got.values()) == {"wrong_type"}


def test_artifacts_without_a_manifest_are_not_read(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/rows/attempt=a")
    assert files.read_artifacts(spark, str(tmp_path)).count() == 0
    assert files.write_artifact(spark.range(4), str(tmp_path), "b", {"fingerprint": "f"}) and files.read_artifacts(spark, str(tmp_path)).count() == 4
    assert [(r.artifact_id, r.row_count) for r in files.read_manifest(spark, str(tmp_path)).collect()] == [("b", "4")]


def test_declared_rules_are_expressions(spark):
    """Each rule parses, and reads columns that are known."""
    for name, rules in audit.RULES.items():
        for rule, test in rules.items():
            columns = set(re.findall(r"[a-z_0-9]+", re.sub("'[^']*'", "", test))) & audit.ALL_COLUMNS
            assert columns, (name, rule)
            spark.range(1).select(*(F.lit(None).cast("string").alias(c) for c in columns)).where(f"not ({test})").schema  # noqa: B018
    names = {c for c, *_ in audit.REFERENCES} | {p for *_, p in audit.REFERENCES} | set(audit.UNIQUE_KEYS) | set(audit.RULES)
    assert len(names) == 20


def test_rules_of_a_parse(spark):
    row = {"normalized_text": "x", "parser_name": "p", "parser_version": "1", "utf8_size_bytes": 1, "character_count": 1, "page_count": 0, "block_count": 0, "duration_ms": 0, "document_metadata_json": "{}", "warnings_json": "[]"}
    bad = {"normalized_text": " ", "utf8_size_bytes": 0, "character_count": 0, "duration_ms": -1, "document_metadata_json": "[]", "warnings_json": "[", "page_count": -1}
    rows = [row | {"id": "good"}] + [row | {"id": k, k: v} for k, v in bad.items()]
    found = audit.rule_violations(spark.createDataFrame(rows), audit.RULES["document_parse"], ["id"]).collect()
    assert {r.id: r.rule for r in found} == {"normalized_text": "normalized_text_not_blank", "utf8_size_bytes": "utf8_size_bytes_from_1", "character_count": "character_count_from_1", "duration_ms": "duration_ms_from_0", "document_metadata_json": "document_metadata_json_json", "warnings_json": "warnings_json_json", "page_count": "page_count_from_0"}


def test_shared_folder(spark):
    assert storage.new_folder(spark, "x") != storage.new_folder(spark, "x")
    assert storage.materialize(spark.range(3)).count() == 3


def test_the_audit_reads_each_table_once(spark, tmp_path):
    """All checks of a table in one scan; a key that a third of the rows refer to, null keys, and keys that aren't there."""
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), (None, "y")], "id string, storage_path string").write.parquet(f"{tmp_path}/document")
    parses = [(str(i), "a" if i < 40 else None if i < 50 else f"z{i % 3}", " " if i % 2 else "t", i - 5) for i in range(100)]
    spark.createDataFrame(parses, "id string, document_id string, normalized_text string, duration_ms int").write.parquet(f"{tmp_path}/document_parse")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    found = audit.audit_model({"document": read("document"), "document_parse": read("document_parse")})
    got = {(r.table, r.rule): r.broken for r in found.collect()}
    assert got == {("document", "unique id"): 0, ("document", "unique storage_path"): 1, ("document_parse", "normalized_text_not_blank"): 50,
        ("document_parse", "duration_ms_from_0"): 5, ("document_parse", "unique id"): 0, ("document_parse", "unique document_id"): 4,
        ("document_parse", "document_id in document"): 50}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
