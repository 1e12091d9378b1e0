"""Embedding inputs, vectors and indexes: preparation, embedding in batches, checks and identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, is_blank, is_finite

POLICY_VERSION = "1"
#: Fixed: models with this prefix want to know what a text is for.
PREFIXED_MODEL, PREFIXES = "nomic-embed-text", {"document": "search_document: ", "query": "search_query: "}


def embedding_input(text: Column, model: Column, purpose: str) -> Column:
    return F.when(F.lower(model).startswith(PREFIXED_MODEL), F.concat(F.lit(PREFIXES[purpose]), text)).otherwise(text)


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic offline vectors: signed counts of hashed words, of length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(sha256(word.encode()).digest()[:8], "big")
                row[h % dimensions] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out.tolist()

    return embed


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch_size: int = 32, text_col: str = "text") -> DataFrame:
    """Adds embedding; texts go to the embedder in order, at most batch_size at once, and whole."""
    from ..sources.files import batches

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches(frames, batch_size):
            vectors = embedder(part[text_col].tolist())
            if len(vectors) != len(part):
                raise ValueError("the embedder must give one vector for each text")
            yield part.assign(embedding=vectors)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInPandas(run, f"{schema}, embedding array<float>")


def validate_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """Adds reject_code: empty_vector, wrong_dimensions, not_finite, or null."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False)))
    return vectors.withColumn("reject_code", F.when(v.isNull() | (F.size(v) == 0), "empty_vector").when(F.size(v) != dimensions,
        "wrong_dimensions").when(~finite, "not_finite"))


def index_complete(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (index_id, chunk_count, vector_count, complete), by index; both sides have index_id."""
    c = chunks.groupBy("index_id").agg(F.count("*").alias("chunk_count"))
    v = vectors.groupBy("index_id").agg(F.count("*").alias("vector_count"))
    rows = c.join(v, "index_id", "full").fillna(0, ["chunk_count", "vector_count"])
    return rows.withColumn("complete", (F.col("chunk_count") == F.col("vector_count")) & (F.col("vector_count") > 0))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors.select("index_id", "chunk_id"), ["index_id", "chunk_id"], "left_anti")


def vector_metadata(*, required: dict[str, Column], optional: dict[str, Column]) -> Column:
    """Map of the required entries and those optional ones that aren't null."""
    entries = [x for k, c in (required | optional).items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def vector_index_fingerprint(
    chunk_set_id: Column, chunk_set_print: Column, *, model: Column, dimensions: Column, provider_model: Column | None = None,
        provider_revision: Column | None = None,
    provider: str = "local", adapter: tuple[str, str] = ("local", "1"), metric: str = "cosine", store: tuple[str, str] = ("table", "1"),
) -> Column:
    """SHA-256 over all that decides the vectors: two revisions of a model, or versions of adapter or store, don't share."""
    unknown = F.lit(None).cast("string")
    fields = {
        "adapter": F.lit(adapter[0]), "adapter_version": F.lit(adapter[1]), "chunk_set_fingerprint": chunk_set_print, "chunk_set_id": chunk_set_id,
        "dimensions": dimensions, "metric": F.lit(metric), "model": model, "policy_version": F.lit(POLICY_VERSION), "provider": F.lit(provider),
        "provider_model": unknown if provider_model is None else provider_model,
            "provider_revision": unknown if provider_revision is None else provider_revision,
        "store": F.lit(store[0]), "store_version": F.lit(store[1]),
    }
    return fingerprint(F.struct(*(c.alias(k) for k, c in fields.items())))


def compatible_indexes(indexes: DataFrame, request: dict[str, object]) -> DataFrame:
    """Adds reject_code: the first reason why an index can't serve the request, or null.

    request: provider, model, distance_metric, input_policy_version, indexer_name, indexer_version, dimensions, and
    provider_model and provider_revision, which are compared only if both sides know them.
    """
    code = F.when(F.col("status") != "ready", "index_not_ready")
    for name in ("provider", "model", "distance_metric", "input_policy_version", "indexer_name", "indexer_version"):
        code = code.when(~F.col(name).eqNullSafe(F.lit(request[name])), f"{name}_mismatch")
    code = code.when(F.coalesce(F.col("dimensions") <= 0, F.lit(True)),
        "invalid_dimensions").when(F.coalesce(F.col("vector_count") <= 0, F.lit(True)), "empty_index").when(is_blank(F.col("collection_name")),
        "missing_collection")
    code = code.when(F.col("dimensions") != F.lit(request["dimensions"]), "query_width_mismatch")
    for name in ("provider_model", "provider_revision"):
        if request.get(name) is not None:
            code = code.when(F.col(name) != F.lit(request[name]), f"{name}_mismatch")
    return indexes.withColumn("reject_code", code)
