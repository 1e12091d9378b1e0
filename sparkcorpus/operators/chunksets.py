"""Chunk sets: provenance of chunks in pages and blocks, deterministic ids, fingerprints, reuse, and the whole build."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import canonical_json, fingerprint, uuid5

#: Our own namespaces of version-5 ids, and the versions that go into fingerprints.
SET_NAMESPACE = "5b0b2d5e-6f0e-4c58-9d5e-2f2c3a1d7e10"
CHUNK_NAMESPACE = "8a7f0c14-93c1-4f0b-8f3a-6b1c9d2e4f20"
VERSION = "1"
#: Chunks come after the ranges of their document.
CHUNK_KIND = 2
#: Buckets that the document hashes of a corpus are dealt to.
RANGES = 4096


def unparsed_documents(documents: DataFrame, parses: DataFrame) -> DataFrame:
    """Documents without a parse, in order of upload."""
    return documents.join(parses.select("document_id"), documents["id"] == parses["document_id"], "left_anti").orderBy("corpus_id", "uploaded_at", "id")


def corpus_readiness(corpora: DataFrame, documents: DataFrame, parses: DataFrame) -> DataFrame:
    """Rows (corpus_id, documents, unparsed, state): unknown, empty, incomplete or ready."""
    parsed = parses.select(F.col("document_id").alias("__p")).distinct()
    counts = documents.join(parsed, F.col("id") == F.col("__p"), "left").groupBy("corpus_id").agg(F.count("*").alias("documents"),
        F.count_if(F.col("__p").isNull()).alias("unparsed"))
    rows = corpora.select(F.col("id").alias("corpus_id"), F.lit(True).alias("known")).join(counts, "corpus_id", "full").fillna(0, ["documents", "unparsed"])
    return rows.select("corpus_id", "documents", "unparsed", F.when(F.col("known").isNull(), "unknown").when(F.col("documents") == 0,
        "empty").when(F.col("unparsed") > 0, "incomplete").otherwise("ready").alias("state"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole batches of events, each with the ranges of the document that the batch before ended in."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            yield table.combine_chunks()
            last = table.column("document_id")[-1].as_py()
            mine = pc.is_null(table.column("document_id")) if last is None else pc.equal(table.column("document_id"), last)
            held = table.filter(pc.and_(pc.fill_null(mine, False), pc.less(table.column("kind"), CHUNK_KIND)))


def _inside(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _met(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the ranges that each of the intervals [a, z) meets, one interval after another; their numbers).

    Ranges are in order of start. Where their ends are in order too, as those of pages and blocks are, what an interval meets
    is one run of them, from the first that ends after a to the last that starts before z.
    """
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    low, high = np.searchsorted(reach, a, "right"), np.searchsorted(starts, z, "left")
    n = np.maximum(high - low, 0)
    at = _inside(low, n)
    if len(ends) and (reach != ends).any():  # a long range goes on over later ones that have ended
        keep = ends[at] > np.repeat(a, n)
        at, n = at[keep], np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n))
    return at, n


def chunk_provenance(chunks: DataFrame, pages: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Adds page_start and page_end, the first and last page that a chunk shares a place with (null if there is none), and
    block_ordinals, the ordinals of such blocks in order; each if pages (page_number) or blocks (ordinal) are given. All tables
    have document_id, start and end. An empty range counts if it's strictly inside.

    One exchange: chunks and ranges are put in one order by document, ranges first, each in order of start, and a task goes
    over them once. It holds the ranges of one document, which its text bounds, and a batch of chunks.
    """
    kinds = [(k, df.select("document_id", F.lit(k).alias("kind"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("z"),
        F.col(key).cast("int").alias("key"))) for k, df, key in ((0, pages, "page_number"), (1, blocks, "ordinal")) if df is not None]
    own = chunks.select("document_id", F.lit(CHUNK_KIND).alias("kind"), F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("z"),
        F.struct(*(f"`{c}`" for c in chunks.columns)).alias("chunk"))
    for _, df in kinds:
        own = own.unionByName(df, allowMissingColumns=True)
    which = [k for k, _ in kinds]
    added = {0: "page_start int, page_end int", 1: "block_ordinals array<int>"}
    names = [*chunks.columns, *(c.split()[0] for k in which for c in added[k].split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            kind, a, z = (table.column(c).to_numpy() for c in ("kind", "a", "z"))
            code = pc.fill_null(table.column("document_id").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            doc = np.cumsum(np.diff(code, prepend=code[0]) != 0).astype(np.int64) << 40  # documents apart on one line of places
            mine = kind == CHUNK_KIND
            if not mine.any():
                continue
            columns = [x for x in table.column("chunk").filter(pa.array(mine)).combine_chunks().flatten()]
            for k in which:
                of = np.flatnonzero(kind == k)
                key = table.column("key").to_numpy()[of].astype(np.int32)
                at, n = _met(doc[of] + a[of], doc[of] + z[of], doc[mine] + a[mine], doc[mine] + z[mine])
                found = key[at]
                row = np.repeat(np.arange(len(n)), n)
                if k == 1:
                    found = found[np.lexsort((found, row))]
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found)))
                else:
                    low, high = np.full(len(n), np.iinfo(np.int32).max), np.full(len(n), np.iinfo(np.int32).min)
                    np.minimum.at(low, row, found)
                    np.maximum.at(high, row, found)
                    columns += [pa.array(x, pa.int32(), mask=n == 0) for x in (low, high)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema), *(added[k] for k in which)])
    order = [F.col("document_id"), F.col("kind"), F.col("a"), F.col("z"), F.col("key")]
    return own.repartition("document_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_start and page_end, see chunk_provenance."""
    return chunk_provenance(chunks, pages=pages)


def chunk_blocks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds block_ordinals, see chunk_provenance."""
    return chunk_provenance(chunks, blocks=blocks)


def chunk_set_id(print_: Column) -> Column:
    return uuid5(SET_NAMESPACE, F.concat(F.lit("chunk-set:"), print_))


def chunk_id(set_id: Column, document_id: Column, ordinal: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", F.lit("chunk"), set_id, document_id, ordinal.cast("string")))


def _set_json(documents: Column, config: str, chunker: str, tokenizer: str, cap: int) -> Column:
    return canonical_json(F.struct(F.lit(cap).alias("cap"), F.lit(chunker).alias("chunker"), F.lit(VERSION).alias("chunker_version"),
        F.lit(config).alias("config"), F.col("corpus_id"), documents.alias("documents"), F.lit(tokenizer).alias("tokenizer")))


def _parsed(documents: DataFrame, parses: DataFrame) -> DataFrame:
    return documents.select("corpus_id", F.col("id").alias("document_id"), "uploaded_at").join(parses.select("document_id", "parse_id"), "document_id")


def chunk_set_fingerprints(documents: DataFrame, parses: DataFrame, config: str, chunker: str, tokenizer: str, cap: int = 32_000) -> DataFrame:
    """Rows (corpus_id, fingerprint): over the ordered documents of a corpus and all that decides its chunks.

    The SHA-256 of one flat JSON text, which goes on document by document: a corpus is read in one task, of which
    nothing is held. `chunk_set_tree_fingerprints` spreads a corpus over tasks.
    """
    around = F.split(_set_json(F.array().cast("array<string>"), config, chunker, tokenizer, cap), '"documents":\\[\\]')
    rows = _parsed(documents, parses).withColumn("around", around)
    rows = rows.repartition("corpus_id").sortWithinPartitions("corpus_id", "uploaded_at", "document_id", "parse_id")
    rows = rows.select("corpus_id", canonical_json(F.struct("document_id", "parse_id")).alias("item"),
        F.concat(F.col("around")[0], F.lit('"documents":[')).alias("head"), F.concat(F.lit("]"), F.col("around")[1]).alias("tail"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # (head, corpus, tail, hash so far); heads differ as corpora do

        def row(now: tuple) -> pa.RecordBatch:
            now[3].update(now[2].encode())
            return pa.record_batch({"corpus_id": now[1], "fingerprint": pa.array([now[3].hexdigest()])})

        for batch in batches:
            corpus = batch.column("corpus_id")
            for i, (head, item, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("head", "item", "tail")), strict=True)):
                if now is None or now[0] != head:
                    if now is not None:
                        yield row(now)
                    now = (head, corpus.take(pa.array([i])), tail, hashlib.sha256((head + item).encode()))
                else:
                    now[3].update(("," + item).encode())
        if now is not None:
            yield row(now)

    return rows.mapInArrow(run, f"corpus_id {rows.schema['corpus_id'].dataType.simpleString()}, fingerprint string")


def chunk_set_tree_fingerprints(documents: DataFrame, parses: DataFrame, config: str, chunker: str, tokenizer: str, cap: int = 32_000) -> DataFrame:
    """Rows (corpus_id, fingerprint) like chunk_set_fingerprints, by a tree of hashes: of each document with its time of
    upload, which is its place in the order; of those of a bucket of hashes; of the buckets of a corpus, RANGES at most."""
    rows = _parsed(documents, parses).select("corpus_id", fingerprint(F.struct("document_id", "parse_id", "uploaded_at")).alias("h"))
    over = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    ranges = rows.groupBy("corpus_id", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(RANGES)).alias("place")).agg(over("h").alias("h"))
    return ranges.groupBy("corpus_id").agg(F.array_sort(F.collect_list("h")).alias("documents")).select("corpus_id",
        F.sha2(_set_json(F.col("documents"), config, chunker, tokenizer, cap), 256).alias("fingerprint"))


def split_reusable(requests: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that a ready artifact with their fingerprint serves, requests to build)."""
    ready = artifacts.where("status = 'ready'").select("fingerprint").distinct()
    return requests.join(ready, "fingerprint", "left_semi"), requests.join(ready, "fingerprint", "left_anti")


def build_chunk_set(
    documents: DataFrame, parses: DataFrame, pages: DataFrame, blocks: DataFrame, chunker: Callable[[DataFrame], DataFrame], config: str,
        chunker_name: str, tokenizer: str = "whitespace"
) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, one row for each chunk set), for the corpora in `documents` whose documents are all parsed.

    chunker gives rows like chunk_fixed from (document_id, text), and runs once; its name is part of the fingerprint.
    Rows (chunk_set_id, corpus_id, fingerprint, chunker_name, chunker_version, status, chunk_count): a corpus with
    unparsed documents has no id, the status `incomplete` and no chunks.
    """
    state = corpus_readiness(documents.select(F.col("corpus_id").alias("id")).distinct(), documents, parses).select("corpus_id", "state")
    known = documents.join(state.where("state = 'ready'"), "corpus_id").drop("state")
    prints = chunk_set_tree_fingerprints(known, parses, config, chunker_name, tokenizer).withColumn("chunk_set_id", chunk_set_id(F.col("fingerprint")))
    meta = known.select(F.col("id").alias("document_id"), "corpus_id", "original_filename",
        "uploaded_at").join(parses.select("document_id", "parse_id"), "document_id")
    chunks = materialize(chunker(parses.select("document_id", "text").join(meta.select("document_id"), "document_id", "left_semi")))
    rows = chunk_provenance(chunks, pages, blocks).join(meta, "document_id").join(prints, "corpus_id")
    source = canonical_json(F.struct("block_ordinals", "original_filename", "parse_id"))
    own = chunk_id(F.col("chunk_set_id"), F.col("document_id"), F.col("ordinal"))
    place = ("ordinal", "text", "start", "end", "token_start", "token_end", "page_start", "page_end")
    rows = rows.select(own.alias("id"), "chunk_set_id", "corpus_id", F.col("document_id").alias("source_document_id"), "uploaded_at", *place,
        source.alias("source_metadata"))
    counts = chunks.join(meta.select("document_id", "corpus_id"), "document_id").groupBy("corpus_id").agg(F.count("*").alias("chunk_count"))
    sets = state.join(prints, "corpus_id", "left").join(counts, "corpus_id", "left").fillna(0, ["chunk_count"])
    sets = sets.select("chunk_set_id", "corpus_id", "fingerprint", F.lit(chunker_name).alias("chunker_name"),
        F.lit(VERSION).alias("chunker_version"), F.col("state").alias("status"), "chunk_count")
    return rows, sets
