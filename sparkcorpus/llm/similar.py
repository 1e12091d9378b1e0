"""Groups of near-duplicates by the exact Jaccard similarity of word shingles: what near-dedup verifies, and the bands that
find the pairs which a fingerprint index of small radius misses.

Candidates come from that index, and from MinHash bands of PERMS / BANDS values: two texts of similarity 0.8 share one of 16 bands with a
chance of 99.98%. Inside a node (the texts that share a band) three edge-disjoint maximum spanning forests of the
estimated similarity are taken, not all pairs, so edges grow with the texts; components at any threshold are those of a
maximum spanning forest of the similarity itself, which the second and third one come nearer to. Every edge is then
checked on the whole shingle sets; only edges of `least` or more count.

A node with over NODE_SIZE texts is never handled in one task. Its texts are first compared with two leaders, and those
that are similar leave it (they still are in their other nodes). If few leave, texts must share one more band each.

What forests and leaders leave out is made up for once groups are known (`across`): in each node, whatever its size, the texts
outside the node's largest group are compared, by their estimates, with all texts of the node that are of another group,
which are read in blocks of NODE_SIZE. Every such pair that wasn't checked before and whose estimate is within SLACK is checked, the best eight
of each text first, as these join most groups. Nodes where a text had more than eight are few, but their pairs are as many as the square of their
texts: they aren't listed, but checked where the texts meet (`beyond`). So the groups are those of all pairs that share a band, at every size of node.

Edge cases: a text of fewer words than a shingle is one shingle; null and wordless texts have the empty set and are
copies of each other. A very long text is read whole, in memory of some 20 times its size. Rows are told apart by id and
text, so null and repeated ids are safe. Of a group the row with the smallest id stays, of one id that with the smallest
hash; equal rows are one row. Other columns are kept and not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (bit_sums, both_ways, bounded_batches, connected_components, fresh, give_back_memory, hash_words, majority, materialize, mix, perhaps, settled,
    shingle_hashes, slices, word_codes, written)

PERMS, BANDS = 64, 16
NODE_SIZE = 1024
FORESTS = 3
#: Texts of so many bytes, or twice as many, are compared in one task.
BLOCK_BYTES = 16 << 20
#: An estimate from 64 values is within 0.2 (four standard deviations) of the similarity.
SLACK = 0.2

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, PERMS, np.uint64)


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, offsets by text), in order of hash in each text."""
    codes, words, ends = word_codes(texts)
    hashes = hash_words(words)
    flat, n = shingle_hashes(codes, hashes, width), np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(codes)) + width <= ends[1:][row]
    found, of = flat[whole[: len(flat)]], row[whole]
    short = np.flatnonzero((n > 0) & (n < width))
    alone = np.array([mix(np.array([hash(tuple(hashes[codes[ends[i] : ends[i + 1]]].tolist())) & (1 << 64) - 1], np.uint64))[0] for i in short], np.uint64)
    found, of = np.concatenate([found, alone]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(n) + 1))


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """Rows (h, key, fp, sig, bands) from (h, text): hash of the shingle set, its SimHash, low bytes of its MinHash values,
    and their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found, ends = shingles(part.column("text"), width)
            n, has = part.num_rows, np.flatnonzero(np.diff(ends))
            low, key = np.zeros((n, PERMS), np.uint64), np.zeros(n, np.uint64)
            if len(has):
                key[has] = mix(np.add.reduceat(mix(found ^ np.uint64(1)), ends[has]) ^ np.bitwise_xor.reduceat(found, ends[has]))
                for j in range(PERMS):
                    low[has, j] = np.minimum.reduceat((found ^ _MASKS[j]) * _FACTORS[j], ends[has])
            mixed = mix(low.reshape(-1)).reshape(n, PERMS)
            rows, bands = PERMS // BANDS, np.zeros((n, BANDS), np.uint64)
            for j in range(rows):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + mixed[:, j::rows])
            sig = [x.tobytes() for x in (mixed & np.uint64(255)).astype(np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.view(np.int64).reshape(-1)))
            fp = np.array([majority(bit_sums(found[a:z]), z - a) for a, z in zip(ends, ends[1:], strict=False)], np.uint64)
            yield pa.record_batch({"h": part.column("h"), "key": pa.array(key.view(np.int64)), "fp": pa.array(fp.view(np.int64)),
                "sig": pa.array(sig, pa.binary()), "bands": lists})

    return texts.select("h", "text").mapInArrow(run, "h long, key long, fp long, sig binary, bands array<long>")


def forest_edges(sig: np.ndarray, h: np.ndarray, floor: float, forests: int = FORESTS) -> list[tuple[int, int]]:
    """Pairs of rows in edge-disjoint maximum spanning forests of the estimated similarity, from `floor` up."""
    n = len(sig)
    weight = np.empty((n, n), np.float64)
    for i in range(n):
        weight[i] = (sig == sig[i]).sum(axis=1)
    # ties are broken by the texts alone, so that all nodes choose the same edges
    u = mix(h.view(np.uint64))
    weight = weight / sig.shape[1] + (mix((u[:, None] ^ u[None, :]).reshape(-1)) >> np.uint64(24)).reshape(n, n) / 2.0**40 / (2 * sig.shape[1])
    np.fill_diagonal(weight, -1)
    out = []
    for _ in range(forests):
        best, near, free = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool)
        found = len(out)
        for _ in range(n):
            i = int(np.where(free, best, -2.0).argmax())
            if best[i] >= floor:
                out.append((i, int(near[i])))
            free[i] = False
            closer = weight[i] > best
            best[closer], near[closer] = weight[i][closer], i
        if len(out) == found:
            break
        for i, j in out[found:]:
            weight[i, j] = weight[j, i] = -1
    return out


def candidates(nodes: DataFrame, floor: float) -> DataFrame:
    """Edges (a, b) of the small nodes: rows (path, key, h, sig)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last node of a batch may go on in the next one

        def edges(rows: pa.Table) -> pa.RecordBatch:
            path, key, h = (rows.column(c).to_numpy() for c in ("path", "key", "h"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(len(h), PERMS)
            cuts = [0, *(np.flatnonzero((np.diff(path) != 0) | (np.diff(key) != 0)) + 1).tolist(), len(h)]
            found = [(x + i, x + j) for x, y in zip(cuts, cuts[1:], strict=False) for i, j in forest_edges(sig[x:y], h[x:y], floor)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.record_batch({"a": pa.array(np.maximum(h[pairs[:, 0]], h[pairs[:, 1]])), "b": pa.array(np.minimum(h[pairs[:, 0]], h[pairs[:, 1]]))})

        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            path, key = rows.column("path").to_numpy(), rows.column("key").to_numpy()
            other = np.flatnonzero((path != path[-1]) | (key != key[-1])) if len(path) else []
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield edges(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held)
        give_back_memory()

    dealt = nodes.select("path", "key", "h", "sig").repartition("path", "key").sortWithinPartitions("path", "key")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def mixed_nodes(narrow: DataFrame) -> DataFrame:
    """Those of the rows (path, key, h, root) whose node has several groups, with its n texts and its largest group, main."""
    sizes = narrow.groupBy("path", "key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("path", "key").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max(F.struct("n", "root"))["root"].alias("main"))
    return narrow.join(mixed.where("groups > 1").drop("groups"), ["path", "key"])


def in_blocks(nodes: DataFrame, blocks: Column, *columns: str) -> DataFrame:
    """Rows (path, key, block, kind, h, root, columns) by (path, key, block) in order of kind: a node's texts are held (kind 0) in one
    of its blocks each, and those outside its largest group are sent to all of them (kind 1)."""
    named = lambda block, kind: ("path", "key", block.alias("block"), F.lit(kind).alias("kind"), "h", "root", *columns)
    held = nodes.select(*named(F.pmod(F.xxhash64("h"), blocks).cast("int"), 0))
    sent = nodes.where("root <> main").select(*named(F.explode(F.sequence(F.lit(0), blocks - 1)), 1))
    return held.union(sent).repartition("path", "key", "block").sortWithinPartitions("path", "key", "block", "kind", "h")


def across(texts: DataFrame, floor: float, rows: int = NODE_SIZE, best: int = 8) -> DataFrame:
    """Edges (a, b) between texts of different groups that share a band and have an estimate of `floor` or more; of each text
    in each block only the `best` ones. Nodes where that left out any are rows of (path, key). texts: rows (h, sig, bands, root).

    Texts outside the largest group of a node are sent to all blocks of the node; a task holds a block and streams them past.
    """
    # nodes of several groups are few: they are found without the estimates, which are then read for their members
    narrow = texts.select("h", "root", F.posexplode("bands").alias("path", "key"))
    nodes = materialize(mixed_nodes(narrow).join(texts.select("h", "sig"), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("path", "key", "block", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            found, cut = [np.zeros((0, 2), np.int64)], set()
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                h, root = (batch.column(c).to_numpy()[x:y] for c in ("h", "root"))
                sig = np.frombuffer(b"".join(batch.column("sig").slice(x, y - x).to_pylist()), np.uint8).reshape(y - x, PERMS)
                if (node := tuple(key[x, :3].tolist())) != now:
                    now, kept = node, []
                if not key[x, 3]:
                    kept.append((h, root, sig))
                    continue
                if not kept:
                    continue
                kept = [tuple(np.concatenate(c) for c in zip(*kept, strict=True))]
                (own_h, own_root, own_sig), = kept
                for i in range(y - x):
                    same = (own_sig == sig[i]).sum(axis=1)
                    at = np.flatnonzero((same >= floor * PERMS - 1e-9) & (own_root != root[i]))
                    if len(at) > best:
                        at = at[np.argsort(-same[at], kind="stable")[:best]]
                        cut.add(node[:2])
                    found.append(np.stack([np.maximum(own_h[at], h[i]), np.minimum(own_h[at], h[i])], axis=1))
            pairs, nodes = np.unique(np.concatenate(found), axis=0), np.array(sorted(cut), np.int64).reshape(-1, 2)
            for x, y in ((pairs, None), (None, nodes)):
                n = len(pairs) if y is None else len(nodes)
                yield pa.record_batch([pa.nulls(n, pa.int64()) if z is None else pa.array(z[:, j]) for z in (x, y) for j in (0, 1)], ["a", "b", "path", "key"])
        give_back_memory()

    return in_blocks(nodes, F.ceil(F.col("n") / rows).cast("int"), "sig").mapInArrow(run, "a long, b long, path long, key long").distinct()


def beyond(texts: DataFrame, cut: DataFrame, pool: DataFrame, owner: DataFrame, floor: float, width: int, least: float, rows: int = NODE_SIZE, most: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) between texts of different groups, checked on the whole shingle sets: those in the nodes (path, key) of `cut` with
    an estimate of `floor` or more. A text has one edge to a group in each block. texts: rows (h, sig, bands, root).

    A pair that shares several bands is compared in the node of the first one: if that isn't of `cut`, it has been checked before.
    """
    # in small queries, each of which the driver holds the plan and the threads of
    every = texts.select("h", "root", "sig", "bands", F.posexplode("bands").alias("p", "key")).withColumn("path", F.col("p").cast("long")).drop("p")
    own = materialize(every.where(perhaps(cut)).join(cut, ["path", "key"], "left_semi").join(owner.select("h", "size"), "h"))
    bytes_ = own.groupBy("path", "key").agg(F.sum("size").alias("bytes"))
    nodes = written(mixed_nodes(own).join(bytes_, ["path", "key"]).join(pool, "h"), "large-nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for part in slices(batches, "text", 1 << 20):
            key = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("path", "key", "block")], axis=1)
            kind, h, root = (part.column(c).to_numpy() for c in ("kind", "h", "root"))
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, PERMS)
            bands = np.array(part.column("bands").flatten()).reshape(-1, BANDS)
            found, ends = shingles(part.column("text"), width)
            close = []
            for i in range(part.num_rows):
                if (node := tuple(key[i].tolist())) != now:
                    now, kept, own = node, [], None
                if not kind[i]:
                    kept.append((h[i], root[i], sig[i].copy(), bands[i].copy(), found[ends[i] : ends[i + 1]].copy()))
                    continue
                if own is None:
                    own = [np.array(c) for c in list(zip(*kept, strict=True))[:4]] or [np.zeros(0, np.int64)] * 2 + [np.zeros((0, PERMS), np.uint8), np.zeros((0, BANDS), np.int64)]
                own_h, own_root, own_sig, own_bands = own
                may = ((own_sig == sig[i]).sum(axis=1) >= floor * PERMS - 1e-9) & (own_root != root[i])
                at, joined = np.flatnonzero(may), set()
                for j in at[(own_bands[at] == bands[i]).argmax(axis=1) == node[0]]:
                    if own_root[j] not in joined and alike(found[ends[i] : ends[i + 1]], kept[j][4], least):
                        joined.add(own_root[j])
                        close.append((max(h[i], own_h[j]), min(h[i], own_h[j])))
            pairs = np.array(close, np.int64).reshape(-1, 2)
            yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    blocks = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("bytes") / most)).cast("int")
    with bounded_batches(texts.sparkSession):
        return settled(in_blocks(nodes, blocks, "sig", "bands", "text").mapInArrow(run, "a long, b long").distinct())


def labelled(edges: DataFrame) -> DataFrame:
    """Adds a label to the edges (a, b): the least text that is two steps from a, at most. Texts of a group share a few labels."""
    ends = both_ways(edges)
    one = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("label"))
    two = ends.join(one, "b").groupBy("a").agg(F.min("label").alias("label"))
    return edges.join(two, "a")


def dealt(edges: DataFrame, owner: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Adds the task t to the edges (a, b). Edges of one label are one task; if their texts have over `most` bytes, they are
    cut into blocks by hash, and the edges between two blocks are one task."""
    edges = settled(labelled(edges))
    members = edges.select("label", F.explode(F.array("a", "b")).alias("h")).distinct().join(owner.select("h", "size"), "h")
    blocks = members.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / most)).alias("blocks"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    return edges.join(blocks, "label").select("a", "b", F.xxhash64("label", part("a"), part("b")).alias("t"))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two ascending sets of hashes have a Jaccard similarity of `least` or more."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if len(x) < least * len(y) - 1e-9:
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def verified(edges: DataFrame, pool: DataFrame, owner: DataFrame, width: int, least: float, most: int = BLOCK_BYTES) -> DataFrame:
    """The edges whose whole shingle sets have a similarity of `least` or more. pool: rows (h, text), one for each text of
    an edge; owner: rows (h, size).

    Texts that are compared meet in one task and are sent there once, whatever their edges; the sets are made there, and
    those of one task are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}
        for part in slices(batches, "text", 1 << 20):
            t, edge, a, b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "edge", "a", "b"))
            found, ends = shingles(part.column("text"), width)
            yes = []
            for i in range(part.num_rows):
                if t[i] != now:
                    now, sets = t[i], {}
                if not edge[i]:
                    sets[a[i]] = found[ends[i] : ends[i + 1]].copy()
                elif alike(sets[a[i]], sets[b[i]], least):
                    yes.append(i)
            yield pa.record_batch({"a": pa.array(a[yes]), "b": pa.array(b[yes])})

    tasks = settled(dealt(edges, owner, most))
    sent = tasks.select("t", F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = pool.join(sent.hint("shuffle_hash"), "h").select("t", F.lit(0).alias("edge"), F.col("h").alias("a"), F.col("h").alias("b"), "text")
    rows = texts.union(tasks.select("t", F.lit(1), "a", "b", F.lit(None).cast("string")))
    with bounded_batches(rows.sparkSession):
        return settled(rows.repartition("t").sortWithinPartitions("t", "edge").mapInArrow(run, "a long, b long"))


def pool_of(texts: DataFrame, wanted: DataFrame, owner: DataFrame) -> DataFrame:
    """Rows (h, text) of the texts h in wanted, one each, written once for all comparisons."""
    wanted = settled(wanted.distinct().join(owner.select("h", "id"), "h"))
    texts = texts.where(perhaps(wanted.select("id", "h")))  # so that the others aren't shuffled
    # by id too, so that the copies of a common text aren't dealt to one task
    own = texts.join(wanted.hint("shuffle_hash"), (texts["h"] == wanted["h"]) & texts["id"].eqNullSafe(wanted["id"]), "left_semi").select("h", "text")
    return written(own if owner.where("n > 1").isEmpty() else own.dropDuplicates(["h"]), "near-texts")


def rooted_by(edges: DataFrame) -> DataFrame:
    """Rows (h, root) of the texts of the edges (a, b): root is the smallest text that is reachable."""
    return settled(connected_components(edges).select(F.col("node").alias("h"), "root"))


def similar_groups(texts: DataFrame, owner: DataFrame, width: int = 5, least: float = 0.8, node_size: int = NODE_SIZE,
    more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (h, root) of the distinct texts of rows (id, h, text) that are in one of the groups that pairs of similarity `least`
    or more make. owner: rows (h, id, n, size), one to read each text from: it's that of n rows, and has so many bytes. more:
    further candidates (a, b) from rows (h, fp).

    Groups are found again only after new links, and from what is known of them: each such step is some ten queries.
    """
    with bounded_batches(texts.sparkSession):
        sketch = materialize(sketches(texts, width).dropDuplicates(["h"]))
    names = materialize(sketch.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("n")))
    # equal sets are one item from here on
    out = sketch.join(names.where("n > 1"), "key").where("h > least").select(F.col("h").alias("a"), F.col("least").alias("b"))
    items = sketch.join(names.select(F.col("least").alias("h")), "h", "left_semi").where("key <> 0")
    # most bands are of one text only: they go before anything else is read for the others
    narrow = items.select("h", F.posexplode("bands").alias("last", "key")).select(F.col("last").cast("long").alias("path"), "key", "last", "h")
    shared = narrow.groupBy("path", "key").count().where("count > 1").drop("count")
    shared_texts = materialize(narrow.join(shared, ["path", "key"]))
    nodes = shared_texts.join(items.select("h", "sig", "bands"), "h")
    left_before, small_edges = None, settled(more(items.select("h", "fp"))) if more else None
    wanted = shared_texts.select("h")
    pool = pool_of(texts, wanted.union(small_edges.select(F.explode(F.array("a", "b")))) if more else wanted, owner)
    while True:
        counted = nodes.groupBy("path", "key").agg(F.count("*").alias("n"), F.min_by("h", F.xxhash64("h", F.lit(1))).alias("l1"),
            F.min_by("h", F.xxhash64("h", F.lit(2))).alias("l2"))
        nodes = materialize(nodes.drop("n", "l1", "l2").join(counted.where("n > 1"), ["path", "key"]))
        found = candidates(nodes.where(F.col("n") <= node_size), least - SLACK)
        small_edges = found if small_edges is None else small_edges.union(found)
        large = nodes.where(F.col("n") > node_size)
        size = large.count()
        if not size:
            break
        if left_before is not None and size > 0.9 * left_before:  # leaders no longer help
            nodes = large.select(F.explode(F.expr(f"filter(sequence(last + 1, greatest(last + 1, {BANDS - 1})), j -> j < {BANDS})")).alias("j"),
                "path", "key", "h", "sig", "bands")
            nodes = nodes.select((F.col("path") * (BANDS + 1) + F.col("j") + 1).alias("path"),
                F.xxhash64("key", F.expr("bands[j]")).alias("key"), F.col("j").alias("last"), "h", "sig", "bands")
            left_before = None
            continue
        left_before = size
        pairs = large.select("path", "key", "h", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l")).where("h <> l")
        close = verified(pairs.select(F.greatest("h", "l").alias("a"), F.least("h", "l").alias("b")).distinct(), pool, owner, width, least)
        out = out.union(close)
        gone = pairs.join(close, (F.greatest("h", "l") == close["a"]) & (F.least("h", "l") == close["b"]), "left_semi")
        # of the two leaders of a node, the second one may leave with the first one, but not the first with the second
        gone = gone.join(counted.select("path", "key", "l1"), ["path", "key"]).where("h <> l1").select("path", "key", "h").distinct()
        nodes = large.join(gone, ["path", "key", "h"], "left_anti")
    tested = settled(small_edges.distinct())
    roots = rooted_by(out.union(verified(tested, pool, owner, width, least)))
    joined = lambda roots, close: rooted_by(roots.select(F.col("h").alias("a"), F.col("root").alias("b")).union(close))
    rooted = lambda roots: items.select("h", "sig", "bands").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    found = settled(across(rooted(roots), least - SLACK, node_size).join(tested, ["a", "b"], "left_anti"))
    new, cut = found.where("a is not null").select("a", "b"), found.where("a is null").select("path", "key")
    if not new.isEmpty():
        close = verified(new, pool, owner, width, least)
        roots = roots if close.isEmpty() else joined(roots, close)
    if not cut.isEmpty():
        close = beyond(rooted(roots), cut, pool, owner, least - SLACK, width, least, node_size)
        roots = roots if close.isEmpty() else joined(roots, close)
    return roots


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, node_size: int = NODE_SIZE,
    more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest id, null ids last.

    The decision is made on narrow columns; whole rows move once, to be matched by id and text.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("h"))
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size")
    ids = settled(rows.groupBy("id", "h").agg(F.count("*").alias("n"), size))
    first = ids.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n", "size")).alias("first"))
    owner = settled(first.select("h", "first.id", "first.n", "first.size"))
    roots = similar_groups(rows, owner, width, least, node_size, more)
    named = first.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    of, at, own = fresh(docs, "of", "at", "own")
    stay = named.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "h")).alias("s")).select(F.col("s.id").alias(of), F.col("s.h").alias(at))
    stay = settled(stay)
    gone = settled(ids.join(stay, (F.col("h") == F.col(at)) & F.col("id").eqNullSafe(F.col(of)), "left_anti").select(F.col("id").alias(id_col), F.col("h").alias(own)))
    mine = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    doubtful = perhaps(gone)  # only rows that may go are shuffled
    judged = mine.where(doubtful).join(stay.hint("shuffle_hash"), (F.col(own) == F.col(at)) & F.col(f"`{id_col}`").eqNullSafe(F.col(of)), "left_semi")
    kept = mine.where(~doubtful).union(judged)
    if not ids.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, own])
    return kept.drop(own)
