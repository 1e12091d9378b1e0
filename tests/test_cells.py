"""Exact search in cells against all distances."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus.functions.storage import shared_folder
from sparkcorpus.operators import cells, search


def clustered():
    """Clusters, zeros, a third of the rows equal, and whole numbers, which tie."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(20, 8)) * 5
    return np.concatenate([middle[rng.integers(0, 20, 900)] + rng.normal(size=(900, 8)) * 0.3, np.zeros((30, 8)), np.tile(middle[:1], (600, 1)),
        rng.integers(-1, 2, (170, 8)).astype(float)])


def tables(spark, x):
    rows = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").repartition(3)
    return rows, rows.withColumnRenamed("chunk_id", "query_id")


def check(found, x, k, metric):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.raw_distance))
    d = np.concatenate([search.distances(x[i : i + 200], x, metric) for i in range(0, len(x), 200)])
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:k]
        own = sorted(got[f"{i:05d}"])
        assert [a[:2] for a in own] == [(j, f"{c:05d}") for j, c in enumerate(order, 1)]
        assert np.allclose([a[2] for a in own], d[i][order], atol=1e-11)


@pytest.mark.parametrize("metric", search.METRICS)
def test_every_vector_as_a_question(spark, metric):
    x = clustered()
    rows, asked = tables(spark, x)
    made = cells.cells(rows, metric, cell_rows=40, block_rows=64)
    check(cells.top_k_in_cells(asked, made, 6), x, 6, metric)
    first, second = cells.visits(made, asked, 6)
    compared = second.agg(F.sum("n")).first()[0] + 64 * len(x)
    assert compared < {"cosine": 0.35, "euclidean": 0.2, "dot_product": 0.5}[metric] * len(x) ** 2
    assert made.blocks.agg(F.max("n")).first()[0] <= 64  # also of the cell that has a third of the rows


def test_many_questions_go_to_cells_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 100)
    x = clustered()[::5]
    rows, asked = tables(spark, x)
    found = search.top_k(asked, rows, 3, "euclidean")
    check(found, x, 3, "euclidean")


def test_fewer_vectors_than_places(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])
    rows, asked = tables(spark, x)
    for metric in search.METRICS:
        check(cells.top_k_in_cells(asked, cells.cells(rows, metric), 5), x, 5, metric)
    assert cells.cells(rows.limit(0)) is None


def test_files_grow_with_the_vectors(spark):
    """Random directions, of which nothing can be left out: questions aren't written once for each block."""
    x = np.random.default_rng(3).normal(size=(3000, 32))
    rows, asked = tables(spark, x)
    rows, asked = rows.localCheckpoint(), asked.localCheckpoint()
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)
    before = size()
    found = cells.top_k_in_cells(asked, cells.cells(rows, cell_rows=40, block_rows=64), 6)
    assert 0 < size() - before < 4 * x.nbytes
    check(found, x, 6, "cosine")


def test_large_numbers_and_ties(spark):
    """Inner products far from 1, whole ones that tie, and floats of 32 bits."""
    x = np.random.default_rng(4).integers(-3, 4, (400, 6)).astype(float) * 1024
    rows, asked = tables(spark, x)
    for metric in search.METRICS:
        check(cells.top_k_in_cells(asked, cells.cells(rows, metric, cell_rows=40, block_rows=64), 5), x, 5, metric)
    single = lambda t: t.withColumn("embedding", F.col("embedding").cast("array<float>"))
    check(cells.top_k_in_cells(asked, cells.cells(single(rows)), 5), x, 5, "cosine")
    check(cells.top_k_in_cells(single(asked), cells.cells(rows, "euclidean"), 5), x, 5, "euclidean")
