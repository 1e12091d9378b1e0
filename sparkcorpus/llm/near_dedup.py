"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints of distinct texts are put under upper nodes, each of which stands for a shared masked bit pattern. With
radius k the 64 bits are cut into k + 1 blocks: two fingerprints that differ in k bits or fewer agree on one whole
block, so every link lies under a node of one of the k + 1 masks. A node with many fingerprints is refined into k + 1
children, which fix a further part of the free bits (links are kept, by the same argument), until it is small. So no
group that one task handles is large, however many near copies there are. Inside a small node the fingerprints are
sorted by Gray rank, runs of them get a mask and pattern of their shared bits, and a search goes down these nodes with
accumulated differences, dropping whole runs as soon as the sum exceeds the radius.

Links are not listed pair by pair: each node gives a forest (at most one edge per fingerprint), and components follow
from large-star/small-star rounds in Spark.

Edge cases: a null or wordless text has fingerprint zero, which links like any other; a bit that is set in just half of
the hashes is 0. A very long text is hashed whole, in pieces. Exact copies share a fingerprint, which is handled once. A
null id is kept with its row and is ignored as a component's name, unless all ids are null. Columns other than id and text
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import bit_sums, connected_components, give_back_memory, majority, materialize, slices

#: A node of the index with more fingerprints is refined. Each level fixes a third of the free bits or more of them, so
#: five levels are enough for this size, however many fingerprints there are.
NODE_SIZE = 1024
#: Fingerprints, or nodes, below one node inside a task.
FAN_OUT = 16
#: Pairs of fingerprints that a search holds at once, about, each some 60 bytes; at least those of one node.
PAIRS = 1 << 19


def text_fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the `width`-word shingles, repeats included; A-Z is lower-cased. Zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(width, len(words)) - 1
    body, first, last = b" ".join(words), starts[: len(words) - span].tolist(), ends[span:].tolist()
    sums = np.zeros(64, np.int64)
    for a in range(0, len(first), 1 << 18):
        pieces = map(body.__getitem__, map(slice, first[a : a + (1 << 18)], last[a : a + (1 << 18)]))
        sums += bit_sums(np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(seed))), ">u8"))
    return majority(sums, len(first))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp): one for each row of docs; fp is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.fromiter((text_fingerprint(x, width, seed) for x in part.column("text").to_pylist()), np.uint64, part.num_rows)
            yield pa.record_batch({"id": part.column("id"), "fp": pa.array(found.view(np.int64))})

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray order: neighbours there differ in one bit."""
    rank = codes.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _runs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut each group [bounds[i], bounds[i+1]) into runs of FAN_OUT: starts and ends of the runs, and groups as offsets of runs."""
    sizes = -(-np.diff(bounds) // FAN_OUT)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.repeat(bounds[:-1], sizes) + (np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)) * FAN_OUT
    return starts, np.minimum(starts + FAN_OUT, np.repeat(bounds[1:], sizes)), offsets


def links_in_groups(codes: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of codes in one group that differ in `radius` bits or fewer.

    codes: by group and there in Gray order; bounds: offsets of the groups. Goes down the levels of runs for all codes
    of all groups at once; acc counts the differences in the bits that the codes below the nodes passed so far share.
    """
    levels, all_of, any_of, groups = [], codes, codes, bounds
    while not levels or (np.diff(groups) > 1).any():
        starts, ends, groups = _runs(groups)
        all_of, any_of = np.bitwise_and.reduceat(all_of, starts), np.bitwise_or.reduceat(any_of, starts)
        levels.append((starts, ends, all_of, all_of | ~any_of))
    query, node = np.arange(len(codes)), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    acc, passed = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64)
    for starts, ends, pattern, mask in reversed(levels):
        new = mask[node] & ~passed
        acc = acc + np.bitwise_count((codes[query] ^ pattern[node]) & new)
        keep = acc <= radius
        query, node, acc, passed = query[keep], node[keep], acc[keep], (passed | new)[keep]
        n = ends[node] - starts[node]
        below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[node], n)
        query, acc, passed, node = np.repeat(query, n), np.repeat(acc, n), np.repeat(passed, n), below
    acc = acc + np.bitwise_count((codes[query] ^ codes[node]) & ~passed)
    keep = (acc <= radius) & (query < node)
    return query[keep], node[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items reaches over the links, by label propagation with pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _split_mask(mask: int, parts: int) -> list[int]:
    """Masks that fix `mask` and each one part of the free bits."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges, edges[1:], strict=False) if y > x]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, radius: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """Edges (a, b) of a graph with the components that all links between the distinct fingerprints `fp` make."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node of a batch may go on in the next one

        def edges(rows: pa.Table) -> pa.RecordBatch:
            path, key, fp = (rows.column(c).to_numpy() for c in ("path", "key", "fp"))
            code = fp.view(np.uint64)
            order = np.lexsort((gray_rank(code), key, path))
            path, key, code = path[order], key[order], code[order]
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1, [len(code)]])
            root = np.arange(len(code))
            # nodes are searched together up to so many pairs, which all may be links
            piece = np.cumsum(np.diff(bounds) ** 2) // PAIRS
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for g, h in zip(cuts, cuts[1:], strict=False):
                low, high = bounds[g], bounds[h]
                root[low:high] = low + forest(high - low, *links_in_groups(code[low:high], bounds[g : h + 1] - low, radius))
            own = root != np.arange(len(code))
            return pa.record_batch({"a": pa.array(code[own].view(np.int64)), "b": pa.array(code[root[own]].view(np.int64))})

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            path, key = rows.column("path").to_numpy(), rows.column("key").to_numpy()
            cut = int(np.flatnonzero((path != path[-1]) | (key != key[-1]))[-1]) + 1 if len(path) and ((path != path[-1]) | (key != key[-1])).any() else 0
            if cut:
                yield edges(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held)
        give_back_memory()

    if node_size < 64:
        raise ValueError("small nodes need very many masks; 64 is the least node size")
    masks, out = _split_mask(0, radius + 1), None
    nodes = codes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("path"),
        F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("n")).select("n.path", "n.key", "fp")
    while True:
        counted = nodes.groupBy("path", "key").count().where("count > 1")
        nodes = materialize(nodes.join(counted, ["path", "key"]))
        small = nodes.where(F.col("count") <= node_size)
        found = small.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(search, "a long, b long")
        out = found if out is None else out.union(found)
        large = nodes.where(F.col("count") > node_size)
        if large.isEmpty():
            return out.distinct()
        parts = [_split_mask(m, radius + 1) for m in masks]
        width = max(map(len, parts))
        table = F.array(*(F.array(*(F.lit(_signed(x)) for x in p)) for p in parts))
        masks = [x for p in parts for x in (*p, *p[-1:] * (width - len(p)))]
        child = F.posexplode(F.element_at(table, F.col("path") + 1)).alias("j", "m")
        nodes = large.select("path", "fp", child).select((F.col("path") * width + F.col("j")).alias("path"),
            F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")


def components(prints: DataFrame, radius: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """Adds component (smallest id that is reachable over links) to rows (id, fp)."""
    codes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(codes.select("fp"), radius, node_size)).select(F.col("node").alias("fp"), "root")
    named = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(named.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """Rows (id, fp, component), one for each row of docs."""
    return components(materialize(fingerprints(docs, id_col, text_col, width)), radius)


def index_edges(items: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the texts of rows (h, fp): those with equal fingerprints, and forests of the index's links."""
    codes = materialize(items.groupBy("fp").agg(F.min("h").alias("least")))
    same = items.select("h", "fp").join(codes, "fp").where("h > least").select(F.col("h").alias("a"), F.col("least").alias("b"))
    named = lambda side: codes.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_h"))
    near = links(codes.select("fp"), radius).join(named("a"), "a").join(named("b"), "b")
    return same.union(near.select("a_h", "b_h"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """docs with one row of each group of texts that pairs with a shingle similarity of `least` or more make.

    The index finds the fingerprints within the radius. Texts just above the similarity of 0.8 differ in about 10 of 64
    bits, which no such index can search, so the bands of `similar` add what it misses; every edge of both is verified on
    the whole texts. Edge cases are those of `similar`.
    """
    return similar.drop_similar(docs, id_col, text_col, width, least, more=lambda items: index_edges(items, radius))
