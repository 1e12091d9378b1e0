"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by multi-index Hamming blocks.

An item of n words is compared with the windows of n words in each document (with the whole document where it is
shorter), by the multiset of their 5-word shingles: similarity = 2 * shared / (sum of both), which weighs a shingle by
its occurrences. Pairs of 0.8 or more are leaks.

1. Windows. Items' shingles are marked in a bit table of bounded size, under the hash of shingle and item size. A window
   can reach the similarity with an item only if enough of its shingles are marked for that size, so only such windows
   are emitted, each with its 64-bit SimHash. The test has false positives, never false negatives.
2. Candidates. Fingerprints are cut into blocks; two that differ in `radius` bits or fewer differ in radius // blocks
   bits or fewer in one block at least. Items are listed under all values that near in each block, windows under their
   own value, both with the item size, and joined. Windows with the same shingles are joined once.
3. The exact similarity of each candidate decides.

Only the bit table is broadcast, from a count of the shingles: 16 bits for each, up to 2**29 bits (64 MB, 32 million
shingles of items). Beyond that it gets fuller and lets more windows through; the result stays the same.

Edge cases: a very long text is read whole. Of several windows with the best similarity the first one is reported. Texts
and items are lower-cased (A-Z) and split at white space, so line breaks don't matter. An item with
fewer words than a shingle has none and matches nothing. Null texts have no words. Repeated items are reported each under
their id; repeated document ids share their rows. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_sums, bits_for, bounded_batches, fresh, hash_words, majority, materialize, mix, shingle_hashes, slices, word_codes

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 7
GOLDEN = 0x9E3779B97F4A7C15
#: Each shingle is marked under the size of its item and under this; a document's shingles are first looked up by this.
ANY_SIZE = 0


def _sized(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of a shingle together with the size of an item."""
    return mix(hashes ^ np.uint64(int(size) * GOLDEN % (1 << 64)))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Sorted; the k-th repetition of a hash becomes another one, so that multisets can be compared as sets."""
    h = np.sort(hashes)
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    k = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(np.where(k > 0, mix(h + k.astype(np.uint64) * np.uint64(GOLDEN)), h))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (item_id, size, fp, shingles, marks) for the items with one shingle or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            codes, words, ends = word_codes(part.column("text"))
            hashes, rows = hash_words(words), []
            for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
                if z - a >= shingle:
                    h = shingle_hashes(codes[a:z], hashes, shingle)
                    marks = np.concatenate([_sized(h, ANY_SIZE), _sized(h, z - a)])
                    rows.append((i, z - a, np.uint64(majority(bit_sums(h), len(h))).astype(np.int64), _numbered(h).view(np.int64), marks.view(np.int64)))
            at, size, fp, sets, marks = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.record_batch({"item_id": part.column("id").take(pa.array(at, pa.int64())), "size": pa.array(size, pa.int32()),
                "fp": pa.array(fp, pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64())), "marks": pa.array(marks, pa.list_(pa.int64()))})

    narrow = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"item_id {narrow.schema['id'].dataType.simpleString()}, size int, fp long, shingles array<long>, marks array<long>")


def bit_table(items: DataFrame, most: int = 29) -> np.ndarray:
    """Bits of the marks of all items, as 64-bit words; its size follows their number up to 2**most bits."""
    marks = items.select(F.explode("marks").alias("m"))
    bits = bits_for(marks.count(), 16, most)
    slot = F.shiftrightunsigned("m", 64 - bits)
    words = marks.select(F.shiftright(slot, 6).alias("w"),
        slot.bitwiseAND(63).cast("int").alias("b")).distinct().groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
        F.col("b"))).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return table.view(np.uint64)


def _marked(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    slot = marks >> np.uint64(64 - (int(len(table)).bit_length() + 5))
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _starts(hits: np.ndarray, first: int, last: int, width: int, need: int) -> np.ndarray:
    """Starts in [first, last] of the windows over `width` positions with `need` of the sorted hits or more."""
    if len(hits) < need:
        return np.zeros(0, np.int64)
    low, high = np.maximum(hits[need - 1 :] - width + 1, first), np.minimum(hits[: len(hits) - need + 1], last)
    n = np.maximum(high - low + 1, 0)
    return np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n))


def windows(docs: DataFrame, table: np.ndarray, sizes: list[int], id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    similarity: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, start, size, fp, shingles): windows that may be similar to an item of `size` words."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def of_document(h: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, size, shingles) of the windows; hits: positions whose shingle may be of some item."""
        for size in sizes:
            width = min(size - shingle + 1, len(h))
            need = max(1, int(np.ceil(similarity * (size - shingle + 1 + width) / 2 - 1e-9)))
            if need > width or len(hits) < need:
                continue
            own = hits[_marked(shared.value, _sized(h[hits], size))]
            for s in _starts(own, 0, len(h) - width, width, need):
                yield int(s), size, width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            codes, words, ends = word_codes(part.column("text"))
            h = shingle_hashes(codes, hash_words(words), shingle)
            rows, seen = [], {}
            at = np.flatnonzero(_marked(shared.value, _sized(h, ANY_SIZE)))
            for i in np.unique(np.searchsorted(ends, at, side="right") - 1):
                a, z = int(ends[i]), int(ends[i + 1]) - shingle + 1
                own = h[a : max(a, z)]
                hits = at[np.searchsorted(at, a) : np.searchsorted(at, max(a, z))] - a
                for start, size, width in of_document(own, hits):
                    shingles = _numbered(own[start : start + width])
                    if (key := shingles.tobytes()) not in seen:
                        seen[key] = np.uint64(majority(bit_sums(own[start : start + width]), width)).astype(np.int64)
                    rows.append((i, start, size, seen[key], shingles.view(np.int64)))
            at_row, start, size, fp, sets = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.record_batch({"doc_id": part.column("id").take(pa.array(at_row, pa.int64())), "start": pa.array(start, pa.int64()),
                "size": pa.array(size, pa.int32()), "fp": pa.array(fp, pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['id'].dataType.simpleString()}, start long, size int, fp long, shingles array<long>")


def _blocks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def candidates(queries: DataFrame, items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of rows (size, fp, ...) of both sides with the same size and fingerprints within the radius; item columns get the prefix item_."""
    value = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
    near = radius // blocks
    flips = [[sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(width), n)] for _, width in _blocks(blocks)]
    listed = lambda j, own, masks: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.lit(j).alias("j"), own.bitwiseXOR(m).alias("v")))
    keys = [listed(j, value(*cut), masks) for j, (cut, masks) in enumerate(zip(_blocks(blocks), flips, strict=True))]
    right = items.select(*(F.col(c).alias(f"item_{c}" if not c.startswith("item_") else c) for c in items.columns),
        F.explode(F.flatten(F.array(*keys))).alias("b")).select("*", F.col("b.j").alias("item_j"), F.col("b.v").alias("item_v")).drop("b")
    left = queries.withColumn("b", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), value(*cut).alias("v")) for j,
        cut in enumerate(_blocks(blocks)))))).select("*", "b.j", "b.v").drop("b")
    pairs = left.join(right, (F.col("size") == F.col("item_size")) & (F.col("j") == F.col("item_j")) & (F.col("v") == F.col("item_v")))
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).drop("j", "v", "item_j", "item_v")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, item_id, similarity, start, n_windows): the best similarity, the first word of the first window that has it, and how many windows are leaks."""
    with bounded_batches(docs.sparkSession):
        known = materialize(item_shingles(items, item_col, item_text_col))
    sizes = [r[0] for r in known.select("size").distinct().orderBy("size").collect()]  # lengths of items in words, few
    with bounded_batches(docs.sparkSession):
        found = materialize(windows(docs, bit_table(known), sizes, id_col, text_col, similarity=similarity).withColumn("key", F.xxhash64("shingles", "size")))
    distinct = found.groupBy("size", "fp", "key").agg(F.first("shingles").alias("shingles"))
    texts = known.groupBy("size", "fp", "shingles").agg(F.min("item_id").alias("item"), F.xxhash64(F.first("shingles")).alias("set")).drop("item")
    pairs = candidates(distinct, texts, radius).dropDuplicates(["size", "fp", "key", "item_set"])
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    exact = pairs.withColumn("similarity",
        2.0 * shared / (F.size("shingles") + F.size("item_shingles"))).where(F.col("similarity") >= similarity - 1e-9).select("size", "fp",
        "key", "item_set", "similarity")
    names = known.select("item_id", F.xxhash64("shingles").alias("item_set"))
    at = found.select("doc_id", "start", "size", "fp", "key").join(exact, ["size", "fp", "key"]).groupBy("doc_id",
        "item_set").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"), F.count("*").alias("n_windows"))
    return at.join(names, "item_set").select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start"), "n_windows")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that hold a leak. Each row is judged by its own text: rows are told apart by id and text."""
    own, row, bad = fresh(docs, "own", "row", "bad")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h")).alias("doc_id"), text.alias("text"))
    found = leaks(rows, items, **options).select(F.col("doc_id.id").alias(bad), F.col("doc_id.h").alias(row)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(bad)) & (F.col(own) == F.col(row))
    return docs.withColumn(own, F.xxhash64(text)).join(found, same, "left_anti").drop(own)
