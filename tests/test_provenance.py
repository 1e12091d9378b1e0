"""Pages and blocks of chunks against all pairs."""

import random

import pytest

from sparkcorpus.operators import chunksets

RANGE = "document_id string, {} int, start long, end long"


def meets(c, r):
    return c[2] < r[3] and r[2] < c[3]


def tables(spark, seed, wild):
    """Documents with pages one after another, some empty, or with ranges anywhere (wild); one has a null id, one no ranges."""
    r, chunks, pages = random.Random(seed), [], []
    for d in [None, *"abcdef"]:
        at = 0
        for n in range(0 if d == "e" else r.randrange(1, 30)):
            size = r.choice([0, 0, 1, 5, 40])
            start = r.randrange(200) if wild else at
            pages.append((d, n if not wild else r.randrange(50), start, start + size))
            at += size + 2
        for n in range(r.randrange(40)):
            start = r.randrange(200)
            chunks.append((d, n, start, start + r.randrange(1, 30), f"text {n}"))
    make = lambda rows, name: spark.createDataFrame(rows, RANGE.format(name)).repartition(3)
    return chunks, pages, spark.createDataFrame(chunks, RANGE.format("ordinal") + ", kind string").repartition(2), make


@pytest.mark.parametrize("wild", [False, True])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_provenance(spark, wild, batch):
    chunks, pages, table, make = tables(spark, 11 + batch, wild)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # documents that go over several batches
    try:
        found = chunksets.chunk_provenance(table, make(pages, "page_number"), make(pages, "ordinal"))
        assert found.columns == [*table.columns, "page_start", "page_end", "block_ordinals"]
        got = sorted(map(tuple, found.collect()), key=str)
        both = chunksets.chunk_blocks(chunksets.chunk_pages(table, make(pages, "page_number")), make(pages, "ordinal"))
        assert sorted(map(tuple, both.collect()), key=str) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for c in chunks:
        mine = [p[1] for p in pages if p[0] == c[0] and meets(c, p)]
        want.append((*c, min(mine, default=None), max(mine, default=None), sorted(mine)))
    assert got == sorted(want, key=str)


def test_one_exchange_by_document(spark):
    _, pages, table, make = tables(spark, 1, False)
    plan = chunksets.chunk_provenance(table, make(pages, "page_number"), make(pages, "ordinal"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(document_id") == 1 and "Join" not in plan


def test_nothing(spark):
    _, pages, table, make = tables(spark, 2, False)
    found = chunksets.chunk_provenance(table, make([], "page_number"), make([], "ordinal")).collect()
    assert {(r.page_start, r.page_end, tuple(r.block_ordinals)) for r in found} == {(None, None, ())}
    assert chunksets.chunk_pages(table.limit(0), make(pages, "page_number")).count() == 0
