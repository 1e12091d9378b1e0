"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, and a merge of the shards' results.

1. Equal vectors are one row with their least ids, as no result needs more of them than it has places. Distinct vectors are
   dealt to shards of about SHARD_ROWS by hash.
2. Each shard gets a graph. The inner product is made a distance by one more coordinate, which gives all vectors of a shard
   the same length. A vector's highest layer is drawn from its hash, each layer having a LINKS-th of the vectors of the one
   below. Vectors are inserted in order of hash: one is linked with those of its nearest predecessors in a layer that are no
   nearer to each other than to it, and they with it, as far as places last. As a shard is bounded, the nearest
   predecessors are found exactly, by a product of matrices, block by block, and not by a search of the unfinished graph.
3. The index is a table of shards: vectors, layers, and neighbours as flat arrays of 32-bit integers, -1 where there is none.
   Every vector is in it.
4. Queries go to all shards of their width in blocks, many at once through each graph: greedily down the upper layers, then
   by best-first search with a list of BREADTH vectors in the lowest one. Scores of what is found are computed again, in
   double precision on the original vectors, and the best ones of all shards are taken.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a null
id. Vectors of another width than the query's are no candidates. Rows equal in id and vector are one; rows with the id of
the query are never its candidates; an id with several vectors gives several lists. Ties go to the smaller id. With fewer
candidates than places all that are found are given. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_finite
from .common import give_back_memory, materialize, mix, written

#: Vectors of a shard, about; queries that go to a shard together.
SHARD_ROWS, QUERY_BLOCK = 8192, 16_384
#: Neighbours of a vector in an upper layer; there are twice as many places in the lowest one. Predecessors that are looked
#: at for them, and the length of the search list.
LINKS, NEAREST, BREADTH = 24, 64, 96
#: Rows of a block of a matrix product, and queries that are searched at once.
ROWS, AT_ONCE = 512, 256


class Graph:
    """The graph of one shard. layers[k] holds (members, neighbours): places of its vectors, and for each a row of places."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vectors, self.layers = vectors, layers
        self.points = _same_length(vectors)


def _same_length(vectors: np.ndarray) -> np.ndarray:
    """The vectors with one more coordinate, scaled so that all have length one: the nearest ones of a query are then those
    of largest inner product."""
    size = (vectors * vectors).sum(axis=1)
    most = size.max(initial=0.0) or 1.0
    return np.concatenate([vectors, np.sqrt(np.maximum(most - size, 0.0))[:, None]], axis=1).astype(np.float32) / np.float32(math.sqrt(most))


def _chosen(points: np.ndarray, own: np.ndarray, near: np.ndarray, places: int) -> np.ndarray:
    """For each point `own` up to `places` of its candidates `near` (rows of places, nearest first, -1 for none): those that
    are nearer to it than to any chosen before, then the nearest of the others."""
    there = near >= 0
    x = points[np.where(there, near, 0)]
    to_own = 1 - np.einsum("ncd,nd->nc", x, points[own])
    between = 1 - x @ x.transpose(0, 2, 1)
    good, count = np.zeros(near.shape, bool), np.zeros(len(near), np.int64)
    for c in range(near.shape[1]):
        apart = ~((between[:, c, :] < to_own[:, c, None]) & good).any(axis=1)
        good[:, c] = there[:, c] & apart & (count < places)
        count += good[:, c]
    # chosen ones first, then the others, each nearest first
    order = np.argsort(np.where(good, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :places]
    out = np.take_along_axis(near, order, axis=1)
    if out.shape[1] < places:
        out = np.pad(out, ((0, 0), (0, places - out.shape[1])), constant_values=-1)
    return out


def _layer(points: np.ndarray, members: np.ndarray, places: int, nearest: int) -> np.ndarray:
    """Neighbours of the members of a layer, as rows of places among all points."""
    n, links = len(members), min(LINKS, places)
    own = points[members]
    forward = np.full((n, links), -1, np.int64)
    for a in range(0, n, ROWS):
        z = min(a + ROWS, n)
        near = own[a:z] @ own[:z].T
        near[np.arange(a, z)[:, None] <= np.arange(z)[None, :]] = -np.inf  # only those before
        k = min(nearest, z)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < z else np.tile(np.arange(z), (z - a, 1))
        value = np.take_along_axis(near, top, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        top = np.where(np.isinf(np.take_along_axis(value, order, axis=1)), -1, np.take_along_axis(top, order, axis=1))
        forward[a:z] = _chosen(own, np.arange(a, z), top, links)
    # links go both ways; a member with more than it has places for chooses again
    src, col = np.nonzero(forward >= 0)
    dst = forward[src, col]
    ends, others = np.concatenate([src, dst]), np.concatenate([dst, src])
    gap = 1 - np.einsum("nd,nd->n", own[ends], own[others])
    order = np.lexsort((gap, ends))
    ends, others = ends[order], others[order]
    first = np.searchsorted(ends, np.arange(n + 1))
    width = min(int(np.diff(first).max(initial=0)), 4 * places)  # beyond, the nearest ones are looked at
    rank = np.arange(len(ends)) - first[ends]
    keep = rank < width
    near = np.full((n, max(width, 1)), -1, np.int64)
    near[ends[keep], rank[keep]] = others[keep]
    out = np.concatenate([_chosen(own, np.arange(a, min(a + ROWS, n)), near[a : a + ROWS], places) for a in range(0, n, ROWS)])
    return np.where(out >= 0, members[np.maximum(out, 0)], -1).astype(np.int32)


def build(vectors: np.ndarray, hashes: np.ndarray, links: int = LINKS, nearest: int = NEAREST) -> Graph:
    """The graph of vectors, which are inserted in this order; their layers are drawn from the hashes."""
    u = (mix(hashes) >> np.uint64(11)).astype(np.float64) / 2.0**53
    height = np.minimum(np.floor(-np.log(u + 2.0**-54) / math.log(links)), 15).astype(np.int64)
    graph = Graph(vectors, [])
    for k in range(int(height.max(initial=0)) + 1):
        members = np.flatnonzero(height >= k)
        graph.layers.append((members.astype(np.int32), _layer(graph.points, members, links if k else 2 * links, nearest)))
    return graph


def search(graph: Graph, queries: np.ndarray, k: int, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the nearest k vectors found for each query, best first; -1 and -inf where there are no more."""
    n, q = len(graph.vectors), len(queries)
    breadth, rows = max(breadth, k), np.arange(q)
    length = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    asked = np.concatenate([queries / length, np.zeros((q, 1))], axis=1).astype(np.float32)
    near = lambda at, own: np.einsum("qcd,qd->qc", graph.points[at], own)
    place = np.full(q, int(graph.layers[-1][0][0]))
    best = near(place[:, None], asked)[:, 0]
    for members, neighbours in reversed(graph.layers[1:]):
        at, moving = np.zeros(n, np.int64), rows
        at[members] = np.arange(len(members))
        while len(moving):
            found = neighbours[at[place[moving]]]
            value = np.where(found >= 0, near(found, asked[moving]), -np.inf)
            top = value.argmax(axis=1)
            high = value[np.arange(len(moving)), top]
            better = high > best[moving]
            moving, found, top, high = moving[better], found[better], top[better], high[better]
            place[moving], best[moving] = found[np.arange(len(moving)), top], high
    neighbours = graph.layers[0][1]
    held = np.full((q, breadth), -1, np.int64)
    value, open_ = np.full((q, breadth), -np.inf, np.float32), np.zeros((q, breadth), bool)
    held[:, 0], value[:, 0], open_[:, 0] = place, best, True
    seen = np.zeros((q, n + 1), bool)  # the last one stands for no neighbour
    seen[rows, place], seen[:, n] = True, True
    active = rows
    while len(active):
        ahead = np.where(open_[active], value[active], -np.inf)
        top = ahead.argmax(axis=1)
        going = np.isfinite(ahead[np.arange(len(active)), top])
        active, top = active[going], top[going]
        if not len(active):
            break
        open_[active, top] = False
        found = neighbours[held[active, top]].astype(np.int64)
        new = ~seen[active[:, None], found]
        seen[active[:, None], found] = True
        fresh = np.where(new, near(np.where(new, found, 0), asked[active]), -np.inf)
        both = np.concatenate([value[active], fresh], axis=1)
        keep = np.argpartition(-both, breadth - 1, axis=1)[:, :breadth]
        value[active] = np.take_along_axis(both, keep, axis=1)
        held[active] = np.take_along_axis(np.concatenate([held[active], found], axis=1), keep, axis=1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), keep, axis=1)
    held = np.where(np.isfinite(value), held, -1)
    exact = np.where(held >= 0, scores(queries, graph.vectors, held), -np.inf)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(held, order, axis=1), np.take_along_axis(exact, order, axis=1)


def scores(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of each query with its vectors. Each is one sum over a row, so that equal vectors have equal scores."""
    return np.stack([(vectors[row] * query).sum(axis=1) for query, row in zip(queries, at, strict=True)]) if len(queries) else np.zeros(at.shape)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, v, width) that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite, some = F.forall(v, lambda x: F.coalesce(is_finite(x), F.lit(False))), F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(finite & some, F.lit(False))).withColumn("width", F.size("v"))


def index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, nearest: int = NEAREST) -> DataFrame:
    """The table of shards from rows (id, v, width): (width, shard, shards, ids, vectors, layers).

    ids: for each vector the least k + 1 ids that have it; vectors: 64-bit floats, flat; layers: members and neighbours as
    flat 32-bit integers.
    """
    kind = rows.schema["id"].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy("width", "v").orderBy("id"))
    # Spark cuts a group at this number of rows before the shuffle already
    least = rows.dropDuplicates(["id", "v"]).withColumn("place", place).where(F.col("place") <= k + 1)
    distinct = written(least.groupBy("width", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("h", F.xxhash64("v")), "distinct-vectors")
    shards = distinct.groupBy("width").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = distinct.join(F.broadcast(shards), "width").withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))  # one row for each width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (width, shard), rows_ in _by_key(batches, ("width", "shard")):
            x = rows_.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            graph = build(x, rows_.column("h").to_numpy().view(np.uint64), links, nearest)
            layers = [[{"members": m.tobytes(), "neighbours": near.tobytes()} for m, near in graph.layers]]
            yield pa.record_batch({"width": pa.array([width], pa.int32()), "shard": pa.array([shard], pa.int32()),
                "shards": rows_.column("shards")[:1].combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()),
                rows_.column("ids").combine_chunks()), "vectors": pa.array([x.tobytes()], pa.binary()),
                "layers": pa.array(layers, pa.list_(pa.struct([("members", pa.binary()), ("neighbours", pa.binary())])))})
        give_back_memory()

    ordered = dealt.repartition("width", "shard").sortWithinPartitions("width", "shard", "h").select("width", "shard", "shards", "h", "ids", "v")
    schema = f"width int, shard int, shards int, ids array<array<{kind}>>, vectors binary, layers array<struct<members:binary,neighbours:binary>>"
    return written(ordered.mapInArrow(run, schema), "vector-graphs")


def _by_key(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        values = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            own = tuple(values[a].tolist())
            if held and own != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = own
            held.append(batch.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def nearest(vectors: DataFrame, asked: Column, k: int = 20, shard_rows: int = SHARD_ROWS, breadth: int = BREADTH,
    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the k nearest found of each row for which `asked`, a condition on `id`, holds."""
    rows = usable(vectors, id_col, vector_col)
    made = index(rows, k, shard_rows)
    return found_in(made, rows.where(asked).dropDuplicates(["id", "v"]), k, breadth)


def found_in(made: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH) -> DataFrame:
    """Rows (query_id, rank, id, score) from an index and queries (id, v, width)."""
    kind = queries.schema["id"].dataType.simpleString()
    queries = materialize(queries.withColumn("qh", F.xxhash64("v")))
    # queries of a width, in blocks, meet each of its shards; both sides are listed, and joined by (width, shard, block)
    sizes = queries.groupBy("width").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    shards = made.groupBy("width").agg(F.first("shards").alias("shards"))
    sent = queries.join(F.broadcast(sizes), "width").join(F.broadcast(shards), "width")
    sent = sent.select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", "qh"),
        F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind"), "id", "qh", "v")
    graphs = made.join(F.broadcast(sizes), "width").select("width", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(0).alias("kind"), "ids", "vectors", "layers")
    both = graphs.unionByName(sent, allowMissingColumns=True).repartition("width", "shard", "block").sortWithinPartitions("width", "shard", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = there = None
        for (width, shard, part, of), table in _by_key(batches, ("width", "shard", "block", "kind")):
            if not of:
                row = table.combine_chunks().to_batches()[0]
                x = np.frombuffer(row.column("vectors")[0].as_buffer(), np.float64).reshape(-1, width)
                layers = []
                for layer in row.column("layers")[0].as_py():
                    members = np.frombuffer(layer["members"], np.int32)
                    layers.append((members, np.frombuffer(layer["neighbours"], np.int32).reshape(len(members), -1)))
                graph, ids, there = Graph(x, layers), row.column("ids")[0].values, (width, shard, part)
                continue
            if there != (width, shard, part):  # few vectors can leave a shard empty
                continue
            for block in table.to_batches(max_chunksize=AT_ONCE):
                q = block.column("v").flatten().to_numpy().reshape(-1, width)
                places, score = search(graph, q, k + 1, breadth)
                at, col = np.nonzero(places >= 0)
                lists = ids.take(pa.array(places[at, col]))
                n = np.diff(lists.offsets.to_numpy())
                mine = np.repeat(at, n)
                yield pa.record_batch({"query_id": block.column("id").take(pa.array(mine)), "qh": block.column("qh").take(pa.array(mine)),
                    "id": lists.flatten(), "score": pa.array(np.repeat(score[at, col], n))})
        give_back_memory()

    found = both.mapInArrow(run, f"query_id {kind}, qh long, id {kind}, score double").where("id <> query_id")
    order = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
