"""Exact batch vector search: distances, top-k for whole question sets, hydration and checks of rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import fresh, is_blank, is_finite, strip
from .cells import cells, top_k_in_cells
from .vectors import compatible_indexes, embed, embedding_input

METRICS = ("cosine", "dot_product", "euclidean")
#: Queries, and bytes of their coordinates, that are broadcast at once.
QUERY_BLOCK, BLOCK_BYTES = 4096, 32 << 20


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """1 - cosine (1 for a zero vector), 1 - dot product, or squared Euclidean distance."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    if metric == "dot_product":
        return 1 - dot(a, b)
    if metric == "euclidean":
        return total(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))))
    return F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(1.0))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, as in `distance`. Blocks are bounded, so that this matrix is.

    Rounded to 12 places, so that equal vectors tie wherever they are in a block.
    """
    if metric == "euclidean":
        return np.round(np.stack([((vectors - q) ** 2).sum(axis=1) for q in queries]), 12)
    if metric == "cosine":
        queries, vectors = _unit(queries), _unit(vectors)
    return np.round(1 - queries @ vectors.T, 12)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, chunk_id, raw_distance): the k nearest chunks of each query, ties by chunk id.

    queries: (query_id, embedding); vectors: (chunk_id, embedding). Up to `block` queries of BLOCK_BYTES are broadcast, and the
    vectors are read once; a task keeps k rows for each query. More queries meet the vectors in cells, see `cells`: the result
    is the same, and what they can't be near to isn't compared.
    """
    if k < 1 or metric not in METRICS:
        raise ValueError("k must be positive and the metric known")
    queries = materialize(queries.select("query_id", "embedding"))  # made once
    spark, (asked, width) = queries.sparkSession, queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    id_type = queries.schema["query_id"].dataType.simpleString()
    chunk_type = vectors.schema["chunk_id"].dataType.simpleString()
    made = cells(vectors.select("chunk_id", "embedding"), metric) if asked > min(block, BLOCK_BYTES // (8 * max(width or 1, 1))) else None
    if made is not None:
        return top_k_in_cells(queries, made, k)
    own = queries.toPandas() if asked <= block else None  # about a block
    if own is None or own.empty:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, chunk_id {chunk_type}, raw_distance double")
    shared = spark.sparkContext.broadcast((own["query_id"].tolist(), np.array(own["embedding"].tolist(), float)))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        best = None
        for frame in frames:
            for a in range(0, len(frame), 2048):
                part = frame.iloc[a : a + 2048]
                d = distances(matrix, np.array(part["embedding"].tolist(), float), metric)
                n = min(k, d.shape[1])
                edge = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                q, c = np.nonzero(d <= edge)  # all ties at the edge
                new = pd.DataFrame({"q": q, "chunk_id": part["chunk_id"].to_numpy()[c], "raw_distance": d[q, c]})
                both = new if best is None else pd.concat([best, new])
                best = both.sort_values(["q", "raw_distance", "chunk_id"]).groupby("q").head(k)
        if best is not None:
            yield best.assign(query_id=[ids[i] for i in best["q"]])[["query_id", "chunk_id", "raw_distance"]]

    found = vectors.select("chunk_id", "embedding").mapInPandas(search, f"query_id {id_type}, chunk_id {chunk_type}, raw_distance double")
    place = Window.partitionBy("query_id").orderBy("raw_distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "raw_distance")


def validate_hits(hits: DataFrame, expected: Column) -> DataFrame:
    """Rows (query_id, hits, valid): right number, ids non-blank and unique, distances finite."""
    rows = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(is_blank(F.col("chunk_id"))).alias("blank"),
        F.count_distinct("chunk_id").alias("ids"), F.count_if(~F.coalesce(is_finite(F.col("raw_distance")), F.lit(False))).alias("odd"))
    return rows.select("query_id", "hits",
        ((F.col("hits") == expected) & (F.col("blank") == 0) & (F.col("ids") == F.col("hits")) & (F.col("odd") == 0)).alias("valid"))


def hydrate(hits: DataFrame, chunks: DataFrame, chunk_set_id: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the text and provenance of their chunks, hits in error: duplicate, missing or of another set).

    A question with one hit in error has no hits: a ranking with holes would be scored as if it were whole.
    """
    n, found, broken = fresh({*hits.columns, *chunks.columns}, "n", "found", "broken")
    own = chunks.where(F.col("chunk_set_id") == chunk_set_id).withColumnRenamed("id", "chunk_id").withColumn(found, F.lit(True))
    asked = Window.partitionBy("query_id")
    # the ids of one question are few, and the window after it needs no other shuffle
    counted = hits.withColumn(n, F.size(F.filter(F.collect_list("chunk_id").over(asked), lambda x: x == F.col("chunk_id"))))
    error = F.when(F.col(n) > 1, "duplicate_chunk").when(F.col(found).isNull(), "missing_or_foreign_chunk")
    joined = counted.join(own, "chunk_id", "left").withColumn(n, error).withColumn(broken, F.max(F.col(n).isNotNull()).over(asked))
    bad = joined.where(F.col(n).isNotNull()).select("query_id", "rank", "chunk_id", F.col(n).alias("error"))
    return joined.where(~F.col(broken)).drop(n, found, broken), bad


def validate_rankings(results: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (query_id, valid). results: (query_id, requested_top_k, chunk_set_id, distance_metric, run_metric); ranks must be 1..n, n within k, chunks of the set."""
    own = chunks.select(F.col("id").alias("chunk_id"), "chunk_set_id").withColumn("known", F.lit(1))
    joined = hits.join(results.select("query_id", "chunk_set_id"), "query_id").join(own, ["chunk_id", "chunk_set_id"], "left")
    ranks = joined.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.count_distinct("rank").alias("ranks"), F.count("known").alias("known"))
    ok = (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("ranks") == F.col("n")) & (F.col("known") == F.col("n")) & (F.col("n") <= F.col("requested_top_k"))
    return results.join(ranks, "query_id", "left").select("query_id",
        ((F.col("n").isNull() | ok) & (F.col("distance_metric") == F.col("run_metric"))).alias("valid"))


def retrieve(
    questions: DataFrame, index: Mapping[str, object], vectors: DataFrame, chunks: DataFrame, k: int,
    embedder: Callable[[list[str]], list[list[float]]], request: Mapping[str, object],
) -> tuple[DataFrame, DataFrame]:
    """(ranked evidence with text, rows (query_id, error)) for questions (query_id, question) against one index.

    index: its row, as `compatible_indexes` reads it, with chunk_set_id; request: what it must be, with provider_model and
    provider_revision of the query vectors where they are known. An index that doesn't fit is refused before anything is
    embedded. Blank questions (blank_question), vectors of another width (query_width_mismatch), lists of hits that aren't
    as long as they should be or not well formed (invalid_hits), and hits without a chunk of the set are errors of their
    question, which then has no evidence. Each question is embedded once.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not str(index.get("chunk_set_id") or "").strip():
        raise ValueError("missing_chunk_set")
    spark, types = questions.sparkSession, {int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"`{n}` {types.get(type(v), 'string')}" for n, v in index.items())
    # the width is known when a question is embedded
    refused = compatible_indexes(spark.createDataFrame([tuple(index.values())], schema), {**request, "dimensions": index["dimensions"]}).first().reject_code
    if refused:
        raise ValueError(refused)
    asked = questions.withColumn("question", strip(F.col("question")))
    blank = asked.where(is_blank(F.col("question"))).select("query_id", F.lit("blank_question").alias("error"))
    texts = asked.where(~is_blank(F.col("question"))).select("query_id", embedding_input(F.col("question"), F.lit(request["model"]), "query").alias("text"))
    embedded = materialize(embed(texts, embedder).select("query_id", "embedding"))
    fits = F.size("embedding") == F.lit(index["dimensions"])
    narrow = embedded.where(~fits).select("query_id", F.lit("query_width_mismatch").alias("error"))
    wanted = min(k, int(index["vector_count"]))
    hits = materialize(top_k(embedded.where(fits), vectors, wanted, str(index["distance_metric"])))
    checked = embedded.where(fits).select("query_id").join(validate_hits(hits, F.lit(wanted)), "query_id", "left")
    invalid = materialize(checked.where(~F.coalesce("valid", F.lit(False))).select("query_id", F.lit("invalid_hits").alias("error")))
    good, bad = hydrate(hits.join(invalid, "query_id", "left_anti"), chunks, str(index["chunk_set_id"]))
    return good, blank.union(narrow).union(invalid).union(bad.select("query_id", "error").distinct())
