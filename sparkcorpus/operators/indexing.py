"""The build of a vector index: one stage with side effects that can be stopped anywhere and goes on where it stopped.

1. The first chunks are embedded at once. What comes back fixes the width of the vectors and the provider's model and
   revision, and with these the fingerprint; an index that is published under it is reused.
2. Chunks are dealt to ranges by hash of id, and each task embeds the chunks of its ranges in order of id. Every COMMIT_CHUNKS
   of a range are checked, written as one Parquet file and put in place by a rename. A file's name says which chunks are in
   it, so a task that finds it there goes on with the next ones: a second attempt of a task, and a second run of a build
   that was stopped, embed only what is missing.
3. When every range is done, vectors are counted and matched with the chunks by id, and the index is published by one
   rename of its manifest row. Before that nobody sees it.

What grows with the index is in its folder alone; the driver gets counts. Chunks are the same for one chunk set, whose
fingerprint is part of the index's. Two builds of one index at a time write equal files and publish one row.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import uuid5
from ..sources.files import publish, published
from .vectors import POLICY_VERSION, embedding_input, vector_index_fingerprint

#: Our own namespace of version-5 ids of indexes.
INDEX_NAMESPACE = "3c9e3f0a-70ad-4b51-8a0d-5f4f7f0c9b72"
#: Texts that go to the embedder at once. Fixed.
BATCH = 32
#: Chunks of one file, and of one range, about.
COMMIT_CHUNKS, RANGE_CHUNKS = 1024, 16_384


@dataclass(frozen=True)
class Embedded:
    """What a provider gives for some texts: vectors in order, and the model and revision that made them, if it knows."""

    vectors: list[list[float]]
    provider_model: str | None = None
    provider_revision: str | None = None


Embedder = Callable[[list[str]], "Embedded | list[list[float]]"]


class EmptyChunkSet(ValueError):
    """There is nothing to index."""


class InvalidEmbedding(ValueError):
    """The provider's vectors don't belong to the texts, or to one vector space."""


def checked(embedder: Embedder, texts: list[str], like: Embedded | None = None) -> Embedded:
    """Vectors of the texts: one for each, all of one width and finite; of the width, model and revision of `like`."""
    found = embedder(texts)
    found = found if isinstance(found, Embedded) else Embedded(found)
    if len(found.vectors) != len(texts):
        raise InvalidEmbedding("the embedder must give one vector for each text")
    width = len((like or found).vectors[0] or ())
    if not width or any(v is None or len(v) != width for v in found.vectors):
        raise InvalidEmbedding("vectors are empty or differ in width")
    if not all(isinstance(x, (int, float)) and math.isfinite(x) for v in found.vectors for x in v):
        raise InvalidEmbedding("a vector isn't finite")
    for name in ("provider_model", "provider_revision"):
        known = getattr(like, name, None)
        if known is not None and getattr(found, name) not in (None, known):
            raise InvalidEmbedding(f"the {name.replace('_', ' ')} changed between batches")
    return found


def index_fingerprint(spark: SparkSession, chunk_set: Mapping[str, str], model: str, first: Embedded, **identity: object) -> tuple[str, str]:
    """(fingerprint, id) of the index of a chunk set (id, fingerprint) by a provider that gives vectors like `first`."""
    text = lambda x: F.lit(x).cast("string")
    print_ = vector_index_fingerprint(text(chunk_set["id"]), text(chunk_set["fingerprint"]), model=text(model), dimensions=F.lit(len(first.vectors[0])),
        provider_model=text(first.provider_model), provider_revision=text(first.provider_revision), **identity)
    row = spark.range(1).select(print_.alias("p")).select("p", uuid5(INDEX_NAMESPACE, F.concat(F.lit("vector-index:"), "p")).alias("id")).first()
    return row["p"], row["id"]


def _commit(folder: str, name: str, rows: pa.Table) -> None:
    """Write a file beside its place and rename it, so that it's there whole or not at all."""
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    aside = f"{path}/_{uuid.uuid4().hex}"  # Spark doesn't read names that begin so
    store.create_dir(path, recursive=True)
    with store.open_output_stream(aside) as out:
        pq.write_table(rows, out)
    store.move(aside, f"{path}/{name}")


def _there(folder: str) -> set[str]:
    store, path = pyarrow.fs.FileSystem.from_uri(folder)
    listed = store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    return {os.path.basename(f.path) for f in listed}


_FILE = pa.schema([("chunk_id", pa.string()), ("embedding", pa.list_(pa.float32())), ("metadata", pa.string())])


def embed_missing(chunks: DataFrame, folder: str, embedder: Embedder, first: Embedded, known: Mapping[str, list[float]], ranges: int,
    commit_chunks: int = COMMIT_CHUNKS) -> int:
    """Embed what isn't in the folder yet, of chunks (chunk_id, text, metadata); how many chunks that was. known: vectors of the
    first batch, by chunk id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now, number, done, made = [], None, 0, set(), 0

        def flush() -> None:
            nonlocal held, number, made
            if not held:
                return
            name = f"{number:06d}-{len(held)}.parquet"
            if name not in done:
                vectors: list[list[float]] = []
                for a in range(0, len(held), BATCH):
                    texts = [t for c, t, _ in held[a : a + BATCH] if c not in known]
                    new = iter(checked(embedder, texts, first).vectors if texts else [])
                    vectors += [known[c] if c in known else next(new) for c, _, _ in held[a : a + BATCH]]
                columns = [[c for c, _, _ in held], vectors, [m for _, _, m in held]]
                _commit(f"{folder}/range={now}", name, pa.table([pa.array(x, f.type) for x, f in zip(columns, _FILE, strict=True)], schema=_FILE))
                made += len(held)
            held, number = [], number + 1

        for frame in frames:
            for part, *row in zip(*(frame[c] for c in ("range", "chunk_id", "text", "metadata")), strict=True):
                if part != now:
                    flush()
                    now, number, done = part, 0, _there(f"{folder}/range={part}")
                held.append(row)
                if len(held) == commit_chunks:
                    flush()
        flush()
        yield pd.DataFrame({"made": [made]})

    dealt = chunks.select(F.pmod(F.xxhash64("chunk_id"), F.lit(ranges)).cast("int").alias("range"), "chunk_id", "text", "metadata")
    dealt = dealt.repartition(min(ranges, 1 << 16), "range").sortWithinPartitions("range", "chunk_id")
    return dealt.mapInPandas(run, "made long").agg(F.sum("made")).first()[0] or 0


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (chunk_id, embedding, metadata) of an index's folder."""
    rows = spark.read.schema("chunk_id string, embedding array<float>, metadata string").parquet(folder)
    return rows.select("chunk_id", "embedding", "metadata")


def build_vector_index(
    chunks: DataFrame, chunk_set: Mapping[str, str], embedder: Embedder, path: str, model: str = "local", metric: str = "cosine",
    metadata: Column | None = None, provider: str = "local", commit_chunks: int = COMMIT_CHUNKS, range_chunks: int = RANGE_CHUNKS,
) -> tuple[dict[str, str], bool]:
    """(manifest row of the index, whether it was there already) for chunks (chunk_id, text) of a chunk set (id, fingerprint).

    metadata: a map of flat entries, see `vector_metadata`. path: a folder that driver and executors share; vectors are under
    the manifest row's collection_name. Fails with EmptyChunkSet, InvalidEmbedding inside a Spark error, or RuntimeError where vectors
    and chunks don't match; what was committed stays for the next run.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), embedding_input(F.coalesce("text", F.lit("")), F.lit(model), "document").alias("text"),
        (F.lit("{}") if metadata is None else F.to_json(metadata)).alias("metadata"))
    begin = rows.orderBy("chunk_id").limit(BATCH).select("chunk_id", "text").collect()
    if not begin:
        raise EmptyChunkSet(chunk_set["id"])
    first = checked(embedder, [r["text"] for r in begin])
    fingerprint, index_id = index_fingerprint(spark, chunk_set, model, first, metric=metric, provider=provider)
    known = published(spark, path, fingerprint)
    if known is not None:
        return known, True
    total = rows.count()
    folder = f"{path}/collections/{fingerprint}"
    # the number of ranges follows from the chunks alone, so a second run deals them like the first one
    embed_missing(rows, folder, embedder, first, dict(zip((r["chunk_id"] for r in begin), first.vectors, strict=True)), max(1, math.ceil(total / range_chunks)), commit_chunks)
    stored = read_vectors(spark, folder)
    vectors, ids = stored.agg(F.count("*"), F.count_distinct("chunk_id")).first()
    lost = rows.join(stored.select("chunk_id"), "chunk_id", "left_anti").count()
    if not total == vectors == ids or lost:
        raise RuntimeError(f"{total} chunks, {vectors} vectors of {ids} chunks, {lost} chunks without one")
    row = {"artifact_id": index_id, "fingerprint": fingerprint, "chunk_set_id": chunk_set["id"], "provider": provider, "model": model,
        "provider_model": first.provider_model, "provider_revision": first.provider_revision, "dimensions": str(len(first.vectors[0])),
        "distance_metric": metric, "input_policy_version": POLICY_VERSION, "indexer_name": "table", "indexer_version": "1",
        "collection_name": folder, "vector_count": str(vectors), "status": "ready"}
    if publish(spark, path, row):
        return row, False
    return published(spark, path, fingerprint) or row, True
