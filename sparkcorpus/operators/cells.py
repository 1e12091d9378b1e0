"""Exact top-k search of very many questions: vectors in cells around pivots, left out by the triangle inequality.

1. Distances of every metric are in the order of distances of points: of unit vectors for the cosine, and for the dot product of
   vectors with one more coordinate, which gives all the same length and is zero for questions. For points the triangle
   inequality holds.
2. Pivots are some of the vectors. Each vector belongs to the cell of the nearest pivot. Vectors are sorted by cell and
   distance from the pivot, and cut into blocks of BLOCK_ROWS, so that a block is a shell (low, high) around its pivot. A cell with
   a third of all vectors is as many blocks as it needs.
3. A question at distance x from a pivot can have nothing nearer than max(x - high, low - x) in a shell. Questions are sorted by
   nearest cell and cut into blocks of QUESTIONS too. A question first meets the blocks of its own cell, then the others.
   The k-th distance found so far, or among the pivots, bounds that of the result, and only questions that a shell can hold something as near
   for are compared with it. Nothing else is computed.
4. All blocks of questions meet all blocks of vectors as a Cartesian product, a block of questions in one task: it streams the blocks of
   vectors from where they are stored, and holds its questions and k rows for each. So nothing is shuffled or written but the vectors,
   the questions and the result, each once: disk grows with them, and only the time may with their product. Questions, vectors, blocks and hits never go
   through the driver; it gets PIVOTS pivots, the bounds of their cells, and k ids of zero vectors.

Zero vectors have no direction: their cosine distance is 1. The k of them with the smallest ids are hits of every question at first,
and a zero question is compared with everything. Where distances hardly differ, as of random points in many dimensions, no exact method can leave much out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import bounded, materialize, new_folder

#: Pivots at most, vectors of a cell and of a block, about, and questions of a block.
PIVOTS, CELL_ROWS, BLOCK_ROWS, QUESTIONS = 4096, 1024, 2048, 2048
#: Bounds are widened by so much, as distances are rounded to 12 places.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """blocks: rows (block, cell, n, low, high, ids, vectors), the vectors as given, flat, in the format of `kind`; pivots: one point a row;
    bounds: for each cell the lowest and highest distance from its pivot, (inf, -inf) for an empty one; zeros: rows (chunk_id) of zero vectors."""

    blocks: DataFrame
    pivots: np.ndarray
    bounds: np.ndarray
    metric: str
    longest: float
    zeros: DataFrame | None
    width: int
    kind: str


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width) if len(column) else np.zeros((0, width))


def points(x: np.ndarray, metric: str, longest: float, question: bool) -> np.ndarray:
    """Points whose distances are in the order of the metric's."""
    if metric == "euclidean":
        return x
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if metric == "cosine":
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    more = np.zeros_like(size) if question else np.sqrt(np.maximum(longest * longest - size * size, 0))
    return np.concatenate([x, more], axis=1)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points of two blocks."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _gap(raw: np.ndarray, size: np.ndarray, metric: str, longest: float) -> np.ndarray:
    """The distance of points that belongs to a raw distance of a question of this length."""
    square = {"euclidean": raw, "cosine": 2 * raw}[metric] if metric != "dot_product" else size * size + longest * longest - 2 * (1 - raw)
    return np.sqrt(np.maximum(square, 0))


def _by_key(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of equal keys in each batch; one that goes on in the next batch comes in two parts."""
    for batch in batches:
        if batch.num_rows:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                yield tuple(values[a].tolist()), batch.slice(a, z - a)


def cells(vectors: DataFrame, metric: str = "cosine", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> Cells | None:
    """The cells of vectors (chunk_id, embedding) of one width; None if there are none. They serve any number of searches."""
    spark, rows = vectors.sparkSession, _typed(vectors, "chunk_id")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, longest, width = rows.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.size("embedding"))).first()
    if not total:
        return None
    chunk_type, kind = (rows.schema[c].dataType.simpleString() for c in ("chunk_id", "embedding"))
    sample = rows.orderBy(F.xxhash64("embedding"), F.xxhash64("chunk_id")).limit(min(PIVOTS, math.ceil(total / cell_rows)))
    pivots = points(np.array([r["embedding"] for r in sample.collect()], float).reshape(-1, width), metric, longest, question=False)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                gap = gaps(points(_matrix(part.column("embedding"), width), metric, longest, question=False), pivots)
                cell = gap.argmin(axis=1)
                yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "gap": pa.array(gap[np.arange(len(cell)), cell]),
                    "chunk_id": part.column("chunk_id"), "embedding": part.column("embedding")})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, place = None, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            nonlocal held, place
            own = pa.Table.from_batches(held).combine_chunks()
            held, place = [], place + 1
            gap, x = own.column("gap").to_numpy(), own.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.record_batch({"block": pa.array([place], pa.int64()), "cell": pa.array([now], pa.int32()), "n": pa.array([len(gap)], pa.int32()),
                "low": pa.array([gap.min()]), "high": pa.array([gap.max()]), "vectors": pa.array([x.tobytes()], pa.binary()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(gap)], pa.int32()), own.column("chunk_id").combine_chunks())})

        for (cell,), run in _by_key(batches, ("cell",)):
            if held and cell != now:
                yield block()
            now = cell
            while run.num_rows:
                room = block_rows - sum(x.num_rows for x in held)
                held.append(run.slice(0, room))
                run = run.slice(room)
                if sum(x.num_rows for x in held) == block_rows:
                    yield block()
        if held:
            yield block()

    order, folder = ("cell", "gap", "chunk_id"), new_folder(spark, "cells")
    pointed = rows.where(square > 0) if metric == "cosine" else rows
    dealt = pointed.mapInArrow(deal, f"cell int, gap double, chunk_id {chunk_type}, embedding {kind}")  # twice, as the ranges need a pass
    ranged = dealt.repartitionByRange(max(1, math.ceil(total / (32 * block_rows))), *order).sortWithinPartitions(*order)
    with bounded(spark):
        ranged.mapInArrow(cut, f"block long, cell int, n int, low double, high double, vectors binary, ids array<{chunk_type}>").write.parquet(folder)
    blocks = spark.read.parquet(folder)
    bounds = np.tile([[math.inf, -math.inf]], (len(pivots), 1))
    for cell, low, high in blocks.groupBy("cell").agg(F.min("low"), F.max("high")).collect():  # PIVOTS rows at most
        bounds[cell] = low, high
    return Cells(blocks, pivots, bounds, metric, longest, rows.where(square == 0).select("chunk_id") if metric == "cosine" else None, width,
        "f4" if kind == "array<float>" else "f8")


def _typed(rows: DataFrame, key: str) -> DataFrame:
    """Vectors of 32-bit floats as they are, others as 64-bit ones."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    return rows.select(key, F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding"))


def _asked(made: Cells, questions: DataFrame, k: int) -> DataFrame:
    """Rows (part, cells, asked, vectors, kind, home, bound): blocks of questions; flat, their vectors, nearest cells and bounds from the pivots."""
    rows = _typed(questions, "query_id")
    id_type, kind = (rows.schema[c].dataType.simpleString() for c in ("query_id", "embedding"))
    longest, metric, pivots, width = made.longest, made.metric, made.pivots, made.width
    empty = made.bounds[:, 1] < 0

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = _matrix(part.column("embedding"), width)
                gap = gaps(points(x, metric, longest, question=True), pivots)
                bound = np.partition(gap, k - 1, axis=1)[:, k - 1] if len(pivots) >= k else np.full(len(x), np.inf)
                if metric == "cosine":
                    bound[~(x != 0).any(axis=1)] = np.inf
                cell = np.where(empty, np.inf, gap).argmin(axis=1)
                yield pa.record_batch({"query_id": part.column("query_id"), "embedding": part.column("embedding"), "cell": pa.array(cell, pa.int32()),
                    "x": pa.array(gap[np.arange(len(x)), cell]), "bound": pa.array(bound)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            ids, cell = own.column("query_id").combine_chunks(), own.column("cell").to_numpy()
            x = own.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return pa.record_batch({"part": pa.array([place], pa.int64()), "cells": pa.array([np.unique(cell)], pa.list_(pa.int32())),
                "asked": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vectors": pa.array([x.tobytes()], pa.binary()),
                "home": pa.array([cell.tobytes()], pa.binary()), "bound": pa.array([own.column("bound").to_numpy().tobytes()], pa.binary())})

        for batch in batches:
            while batch.num_rows:
                room = QUESTIONS - sum(x.num_rows for x in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(x.num_rows for x in held) == QUESTIONS:
                    yield block()
                    held, place = [], place + 1
        if held:
            yield block()

    order = ("cell", "x", "query_id")
    dealt = rows.mapInArrow(near, f"query_id {id_type}, embedding {kind}, cell int, x double, bound double")
    ranged = dealt.repartitionByRange(max(1, math.ceil(questions.count() / QUESTIONS)), *order).sortWithinPartitions(*order)
    cut_ = ranged.mapInArrow(cut, f"part long, cells array<int>, asked array<{id_type}>, vectors binary, home binary, bound binary")
    return materialize(cut_.withColumn("kind", F.lit("f4" if kind == "array<float>" else "f8")))


def _wide(bound):
    return bound * (1 + SLACK) + SLACK


class _Found:
    """The k nearest so far of a block of questions."""

    def __init__(self, metric: str, longest: float, k: int, ids: pa.Array, x: np.ndarray, home: np.ndarray, bound: np.ndarray, zeros: pa.Array) -> None:
        self.metric, self.longest, self.k, self.asked, self.home, self.bound = metric, longest, k, ids, home, bound
        self.points, self.size = points(x, self.metric, self.longest, question=True), np.sqrt((x * x).sum(axis=1))
        self.limit = np.full(len(x), np.inf)  # the k-th raw distance
        self.met = np.zeros(len(x), bool)  # compared with a block
        self.q, self.raw, self.ids = np.repeat(np.arange(len(x)), len(zeros)), np.ones(len(x) * len(zeros)), pa.concat_arrays([zeros] * len(x)) if len(x) else zeros
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.merge()

    def merge(self) -> None:
        """Take in what was held."""
        q, raw = (np.concatenate([x, *(h[i] for h in self.held)]) for i, x in enumerate((self.q, self.raw)))
        ids = pa.concat_arrays([self.ids, *(h[2] for h in self.held)])
        self.held = []
        keys = [(c, "ascending") for c in ("q", "raw", "id")]
        order = pc.sort_indices(pa.table({"q": q, "raw": raw, "id": ids}), sort_keys=keys, null_placement="at_start")
        at = order.to_numpy()
        q, raw = q[at], raw[at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.raw, self.rank, self.ids = q[keep], raw[keep], place[keep] + 1, ids.take(order.filter(pa.array(keep)))
        last = self.rank == self.k
        self.limit[self.q[last]] = self.raw[last]
        if last.any():
            own = self.q[last]
            kth = _gap(self.raw[last], self.size[own], self.metric, self.longest)
            ok = self.size[own] > 0 if self.metric == "cosine" else np.ones(len(own), bool)
            self.bound[own[ok]] = np.minimum(self.bound[own[ok]], kth[ok])

    def near(self, pivot: np.ndarray, low: float, high: float, own: np.ndarray) -> np.ndarray:
        """Those of the questions `own` that a shell can hold something as near for."""
        x = gaps(self.points[own], pivot[None, :])[:, 0]
        return own[np.maximum(x - high, low - x) <= _wide(self.bound[own])]

    def exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Raw distances of points, row by row, as `search.distance` defines them, rounded to 12 places."""
        return np.round(((p - q) ** 2).sum(axis=1) if self.metric == "euclidean" else 1 - np.einsum("ij,ij->i", q, p), 12)

    def compare(self, own: np.ndarray, p: np.ndarray, ids: pa.Array) -> None:
        """Compare these questions with the points p, whose ids are in order."""
        far, n, n_axes = self.metric == "euclidean", len(p), p.shape[1]
        # of unit vectors, products of 32-bit floats tell which are worth exact ones
        kind, square = np.float32 if self.metric == "cosine" else np.float64, (p * p).sum(axis=1)
        some = max(1, (1 << 20) // n_axes)  # ties can be very many
        slack = 1.2e-7 * (n_axes + 4) if kind is np.float32 else 1e-11
        turned = p.astype(kind).T
        for a in range(0, len(own), 256):
            at = own[a : a + 256]
            q, limit = self.points[at], self.limit[at]
            close, mine = q.astype(kind) @ turned, (q * q).sum(axis=1)
            if far:
                close = 2 * close - square
            least = mine - limit if far else 1 - limit
            new = np.isinf(limit)
            if new.any() and self.k < n:
                least[new] = np.partition(close[new], n - self.k, axis=1)[:, n - self.k]
            least -= slack + (1e-9 * (1 + mine + square.max()) if far else 1e-15 * n_axes * np.sqrt(mine * square.max()))
            row, col = np.divmod(np.flatnonzero(close >= least.astype(kind)[:, None]), n)
            raw = np.concatenate([self.exact(q[row[i : i + some]], p[col[i : i + some]]) for i in range(0, max(len(row), 1), some)])
            keep = raw <= limit[row]
            row, col, raw = row[keep], col[keep], raw[keep]
            order = np.lexsort((col, raw, row))
            row, col, raw = row[order], col[order], raw[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
            if keep.any():
                self.held.append((at[row[keep]], raw[keep], ids.take(pa.array(col[keep]))))
        if sum(len(h[0]) for h in self.held) >= len(self.size):
            self.merge()


def _search(made: Cells, questions: DataFrame, k: int, count: bool = False) -> DataFrame:
    """Rows (query_id, rank, chunk_id, raw_distance); to count, instead rows (part, block, first, n): how many distances are
    computed with a block, for questions of which it's the first and for others."""
    asked = _asked(made, questions, k)
    id_type, chunk_type = (t.elementType.simpleString() for t in (asked.schema["asked"].dataType, made.blocks.schema["ids"].dataType))
    pivots, width, kind = made.pivots, made.width, made.kind
    metric, longest = made.metric, made.longest
    zeros = [] if made.zeros is None else [r[0] for r in made.zeros.orderBy("chunk_id").limit(k).collect()]  # k ids
    # one partition, so that a block of questions meets everything in one task; the last row only brings the questions
    blocks = made.blocks.select("block", "cell", "low", "high", "ids", F.col("vectors").alias("these"))
    empty = blocks.sparkSession.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema), F.lit(1).alias("round"))
    rounds = [blocks.withColumn("round", F.lit(i)) for i in (0, 1)]
    streamed = rounds[0].union(rounds[1]).union(empty).coalesce(1).hint("shuffle_replicate_nl")
    pairs = streamed.join(asked, (F.col("round") == 1) | F.array_contains("cells", F.col("cell")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Found] = {}
        now, p, ids = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("part", "block", "round", "cell", "low", "high")}
                row = {c: v.as_py() for c, v in row.items()}
                if row["part"] not in found:
                    x = np.frombuffer(batch.column("vectors")[i].as_buffer(), batch.column("kind")[i].as_py()).reshape(-1, width).astype(float)
                    bound = np.frombuffer(batch.column("bound")[i].as_buffer(), np.float64).copy()
                    nil = pa.array(zeros, batch.schema.field("ids").type.value_type)
                    home = np.frombuffer(batch.column("home")[i].as_buffer(), np.int32).copy()
                    found[row["part"]] = _Found(metric, longest, k, pa.concat_arrays([batch.column("asked")[i].values]), x, home, bound, nil)
                if row["block"] is None:
                    continue
                here = found[row["part"]]
                at_home = here.home == row["cell"]
                near = here.near(pivots[row["cell"]], row["low"], row["high"], np.flatnonzero(at_home if row["round"] == 0 else ~at_home))
                if len(near):
                    if row["block"] != now:
                        now, ids = row["block"], batch.column("ids")[i].values
                        x = np.frombuffer(batch.column("these")[i].as_buffer(), kind).reshape(-1, width).astype(float)
                        order = pc.array_sort_indices(ids, null_placement="at_start")  # ties go by id
                        p, ids = points(x, metric, longest, question=False)[order.to_numpy()], ids.take(order)
                    here.compare(near, p, ids)
                    first = int((~here.met[near]).sum())
                    here.met[near] = True
                    if count:
                        n = [first * len(ids), (len(near) - first) * len(ids)]
                        yield pa.record_batch({"part": pa.array([row["part"]] * 2, pa.int64()), "block": pa.array([now] * 2, pa.int64()),
                            "first": pa.array([True, False]), "n": pa.array(n, pa.int64())})
        for x in found.values() if not count else ():
            x.merge()
            yield pa.record_batch({"query_id": x.asked.take(pa.array(x.q)), "rank": pa.array(x.rank, pa.int32()), "chunk_id": x.ids, "raw_distance": pa.array(x.raw)})

    out = "part long, block long, first boolean, n long" if count else f"query_id {id_type}, rank int, chunk_id {chunk_type}, raw_distance double"
    folder = new_folder(pairs.sparkSession, "nearest")
    made_ = pairs.mapInArrow(run, out)
    made_.write.parquet(folder)
    return pairs.sparkSession.read.schema(made_.schema).parquet(folder)


def visits(made: Cells, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What a search computes: of each question with the first block that it's compared with, and with the others: rows (part, block, first, n), n
    distances."""
    with bounded(questions.sparkSession):
        done = _search(made, questions, k, count=True)
    return done.where("first"), done.where("not first")


def top_k_in_cells(questions: DataFrame, made: Cells, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, chunk_id, raw_distance): the k nearest chunks of each question (query_id, embedding), ties by
    chunk id. Question ids are unique."""
    with bounded(questions.sparkSession):
        return _search(made, questions, k)
