import random

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import canonical, chunking


def spans(df):
    return [(r.token_start, r.token_end) for r in df.orderBy("document_id", "ordinal").collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")


def test_fixed_windows(spark):
    assert spans(chunking.chunk_fixed(docs(spark, "a b c d e"), 3, 1)) == [(0, 3), (2, 5)]
    assert spans(chunking.chunk_fixed(docs(spark, "a b c", "", None, "  "), 3, 1)) == [(0, 3)]


def test_recursive_prefers_sentences(spark):
    assert spans(chunking.chunk_recursive(docs(spark, "One two three. Four five six. Seven eight."), 5, 1)) == [(0, 3), (2, 6), (5, 8)]


def test_paragraphs_are_packed_and_cut(spark):
    text = "a b\n\nc d\n\n" + " ".join("efghijklm") + "\n\nx"
    assert spans(chunking.chunk_paragraph(docs(spark, text), 4)) == [(0, 4), (4, 8), (8, 12), (12, 13), (13, 14)]


def test_one_huge_token(spark):
    rows = chunking.chunk_fixed(docs(spark, "x" * 32_007), 10, 0).orderBy("ordinal").collect()
    assert [(r.end - r.start, r.token_start) for r in rows] == [(32_000, None), (7, None)]


def test_bad_sizes(spark):
    for size, overlap in ((0, 0), (3, 3), (3, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_fixed(docs(spark, "a"), size, overlap)


def random_text(random_):
    return "".join(random_.choice(["ab", "c", " ", "  ", "\n", "\n\n", ". ", "。", "? ", "é", "日本"]) for _ in range(random_.randrange(400)))


@pytest.mark.parametrize("partitions", [1, 7])
def test_invariants(spark, partitions):
    texts = [random_text(random.Random(i)) for i in range(60)]
    source = docs(spark, *texts).repartition(partitions)
    for chunks, size, overlap in ((chunking.chunk_fixed(source, 7, 2), 7, 2), (chunking.chunk_recursive(source, 7, 2), 7, 2), (chunking.chunk_paragraph(source, 7), 7, 0)):
        by = {}
        for r in chunks.orderBy("document_id", "ordinal").collect():
            by.setdefault(int(r.document_id), []).append(r)
        for i, text in enumerate(texts):
            n, rows = len(chunking.whitespace_tokens(text)[0]), by.get(i, [])
            assert all(text[r.start : r.end] == r.text and r.text and r.token_end - r.token_start <= size for r in rows)
            assert {k for r in rows for k in range(r.token_start, r.token_end)} == set(range(n))
            assert [r.ordinal for r in rows] == list(range(len(rows)))
            assert all(b.token_start >= a.token_end - overlap for a, b in zip(rows, rows[1:], strict=False))


def test_empty_page_keeps_its_place(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, ""), ("d", 3, "two")], "document_id string, page_number int, text string")
    blocks = spark.createDataFrame([], "document_id string, page_number int, block_index int, text string")
    texts = canonical.page_text(pages, blocks)
    assert [tuple(r)[2:] for r in canonical.page_offsets(texts).orderBy("page_number").collect()] == [(0, 3), (3, 3), (5, 8)]
    assert canonical.canonical_text(texts).first().text == "one\n\ntwo"


def test_bad_parses(spark):
    rows = spark.createDataFrame([(" ", "1", "{}", "x"), ("p", "1", "{nope", "x"), ("p", "1", '{"a":NaN}', "x"), ("p", "1", "{}", " \n"), ("p", "1", "{}", "x")], "parser_name string, parser_version string, metadata string, text string")
    assert [r.reject_code for r in canonical.validate_parses(rows).select(F.col("reject_code")).collect()] == ["invalid_parser_output"] * 3 + ["empty_parsed_document", None]
