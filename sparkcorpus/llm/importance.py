"""Importance resampling: documents are drawn with chances that make them look like a target corpus.

A feature is a run of 1 to 3 consecutive words, and falls into one of BUCKETS buckets by the CRC-32 of its bytes. A bucket's
gain is the logarithm, in thousandths, of how much more likely it is in the target; a document's weight is the sum of the
gains of its features. Weights with Gumbel noise, which is a function of the id, are scores, and the highest scores are the
sample (drawing without replacement in proportion to exp(weight)).

1. The buckets' totals of both corpora are summed in the tasks: a task passes on BUCKETS rows at most, whatever it reads. The
   gains are BUCKETS whole numbers, the one thing that tasks get.
2. Weights are bit-sliced. A document's counts become planes of BUCKETS bits: plane k has the k-th bit of every count. The
   gains become planes too, those above zero and those below apart. The weight is the sum, over all pairs of planes, of 2 to
   the power of their places times the number of bits that both have: exact, and 157 words a pair, however long the text.
3. Ranks follow from one sort by ranges of scores and the sums of the ranges before. Rows equal in id and text are one row with
   a number of copies, so that they are never gathered in one task.

The CRC of a run of words follows from the CRCs of its words, as a CRC is linear: each distinct word of a slice of texts is
hashed once, and runs are put together by table lookups for all positions at once.

Edge cases: A-Z is lower-cased and nothing else; other characters than digits, letters a-z and those beyond ASCII separate
words. Null and wordless texts have no features and the weight 0. Short texts are weighed and scored, but not drawn. A very long text is
counted in slices of FEATURES. Rows with a null id share one noise and come last among equal scores; of equal ids, that with
the smaller hash of the text comes first. Without targets or documents the formula holds with zeros. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, slices, word_codes, written

BUCKETS, RUN = 10_000, 3
#: Least words of a document that may be drawn, and the percentage of such documents that is.
LEAST_WORDS, PERCENT = 20, 5
#: Documents whose counts are held at once, and positions of a long text that are counted at once.
DOCS, FEATURES = 64, 1 << 20
#: Rows in one range of scores, about.
RANGE_ROWS = 1 << 20
_WORDS = -(-BUCKETS // 64)
#: CRCs are moved on by fewer bytes than this in one lookup.
_SHORT = 32

#: A-Z to a-z, what separates words to a blank, all else as it is.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = ord(" ")
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & np.uint32(255)]
    for j in range(1, 4):
        out = out ^ table[j][crc >> np.uint32(8 * j) & np.uint32(255)]
    return out


def _shifts(most: int) -> np.ndarray:
    """Tables [n, j, b]: what becomes of byte j of a CRC with the value b when n < most zero bytes follow."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])]
    while len(out) < most:
        out.append(byte[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


_SHIFTS = _shifts(_SHORT + 1)


def follow(crc: np.ndarray, more: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of strings with the CRCs `crc`, each followed by a string of `size` bytes with the CRC `more`."""
    long, low = size >= _SHORT, size % _SHORT
    if long.any():
        crc, table, left = crc.copy(), _SHIFTS[_SHORT], size // _SHORT
        while left.any():  # digit by digit: a table applied to itself has twice the length
            at = np.flatnonzero(left & 1)
            crc[at] = _shifted(table, crc[at])
            table, left = _shifted(table, table), left >> 1
    table, at = _SHIFTS.reshape(-1), low * 1024
    out = more.copy()
    for j in range(4):
        out ^= table[at + (256 * j) + (crc >> np.uint32(8 * j) & np.uint32(255))]
    return out


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a blank in place of each character that separates words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    own = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_FOLD[own]))


class Runs:
    """The features of some texts: words of each text, and the bucket of each run of words."""

    def __init__(self, texts: pa.Array) -> None:
        self.codes, words, self.ends = word_codes(folded(texts), lower=False)
        at, body = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1], (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        bare = map(body.__getitem__, map(slice, at[:-1].tolist(), at[1:].tolist()))
        self.crc, size = np.fromiter(map(zlib.crc32, bare), np.uint32, len(words)), np.diff(at)
        self.joined, self.size = follow(np.full(len(words), zlib.crc32(b" "), np.uint32), self.crc, size), size + 1
        self.words = np.diff(self.ends)

    def buckets(self, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, counted from `first` on; bucket) of each run in the texts [first, last), FEATURES words at a time."""
        own = self.ends[first : last + 1]
        for a in range(int(own[0]), int(own[-1]), FEATURES):
            z = min(a + FEATURES, int(own[-1]))
            text = np.repeat(np.arange(last - first), np.diff(np.clip(own, a, z)))
            end, at = own[text + 1], np.arange(a, z)
            run = self.crc[self.codes[a:z]]
            for k in range(RUN):
                if k:
                    whole = at + k < end
                    at, end, text = at[whole], end[whole], text[whole]
                    new = self.codes[at + k]
                    run = follow(run[whole], self.joined[new], self.size[new])
                yield text, (run % np.uint32(BUCKETS)).astype(np.int64)

    def totals(self) -> np.ndarray:
        """Features of all texts by bucket."""
        return sum((np.bincount(b, minlength=BUCKETS) for _, b in self.buckets(0, len(self.words))), np.zeros(BUCKETS, np.int64))

    def counts(self) -> Iterator[np.ndarray]:
        """Counts by text and bucket, for DOCS texts at a time."""
        for first in range(0, len(self.words), DOCS):
            last = min(first + DOCS, len(self.words))
            out = np.zeros((last - first) * BUCKETS, np.int32)
            for text, bucket in self.buckets(first, last):
                cells, n = np.unique(text * BUCKETS + bucket, return_counts=True)
                out[cells] += n.astype(np.int32)
            yield out.reshape(-1, BUCKETS)


def planes(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bit planes of rows of numbers: (place k, rows that have the bit anywhere, their k-th bits, BUCKETS of them in 64-bit words)."""
    most = numbers.max(axis=1, initial=0)
    for k in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> k)
        own = numbers if len(rows) == len(numbers) else numbers[rows]
        out = np.zeros((len(rows), _WORDS * 8), np.uint8)
        packed = np.packbits((own & (1 << k)).astype(bool), axis=1)
        out[:, : packed.shape[1]] = packed
        yield k, rows, out.view(np.uint64)


def weights(counts: np.ndarray, gains: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Sum of the gains of each row of counts. gains: (sign, place, plane), from `gain_planes`."""
    out = np.zeros(len(counts), np.int64)
    for k, rows, plane in planes(counts):
        for sign, j, gain in gains:
            out[rows] += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (k + j))
    return out


def gain_planes(gains: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    signed = [(1, np.maximum(gains, 0)), (-1, np.maximum(-gains, 0))]
    return [(sign, j, plane[0]) for sign, size in signed for j, _, plane in planes(size[None, :])]


def bucket_totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (bucket, n): the features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, "text", 1 << 20):
            total += Runs(part.column("text")).totals()
        found = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(found.astype(np.int32)), "n": pa.array(total[found])})

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (bucket, gain), one for each bucket."""
    totals = bucket_totals(docs, text_col).withColumnRenamed("n", "s").join(bucket_totals(target, text_col).withColumnRenamed("n", "t"), "bucket", "full")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    rows = materialize(every.join(totals, "bucket", "left").fillna(0, ["s", "t"]))
    sums = rows.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    ratio = (F.col("t") + 1.0) * (F.col("all_s") + float(BUCKETS)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(BUCKETS)))
    return rows.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000.0 * F.ln(ratio)).alias("gain"))  # one row of sums


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, n_words, n_features, weight), one for each row of docs; h is the text's hash."""
    shared = gain_planes(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            runs = Runs(part.column("text"))
            weight = [weights(counts, shared) for counts in runs.counts()]
            features = sum(np.maximum(runs.words - k, 0) for k in range(RUN))
            yield pa.record_batch({"id": part.column("id"), "h": part.column("h"), "n_words": pa.array(runs.words),
                "n_features": pa.array(features), "weight": pa.array(np.concatenate([np.zeros(0, np.int64), *weight]))})

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, h long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = 42) -> Column:
    """Gumbel noise of an id in thousandths, as a whole number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000.0 * F.ln(-F.ln(u)))


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, h, n_words, n_features, weight, score, rank): the rank is null beyond `most`."""
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("h")]
    parts = max(1, math.ceil(rows.count() / RANGE_ROWS))
    # cut once, as two evaluations might cut at other places
    dealt = materialize(distinct.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = dealt.groupBy("part").agg(F.sum("copies").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("place", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(bases), "part")
    each = placed.select(*rows.columns, (F.col("base") + F.col("place")).alias("place"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    rank = F.col("place") + F.col("copy")
    return each.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, h, n_words, n_features, weight, score, rank), one for each row of docs; those with a rank are the sample."""
    gains = np.zeros(BUCKETS, np.int64)
    for bucket, gain in bucket_gains(docs, target, text_col).toLocalIterator():  # BUCKETS rows
        gains[bucket] = gain
    rows = weighted(docs, gains, id_col, text_col)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "importance")
    fit = rows.where(F.col("n_words") >= least_words)
    return ranked(fit, fit.count() * percent // 100).union(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are drawn. Rows equal in id and text have ranks one after another, so the end of the sample cuts
    one group of them at most; of that one, any rows are taken."""
    found = resample(docs, target, percent, least_words, seed, id_col, text_col)
    of, at = fresh(docs, "of", "at")
    groups = materialize(found.groupBy(F.col("id").alias(of), F.col("h").alias(at)).agg(F.count("*").alias("n"), F.count("rank").alias("taken")).where("taken > 0"))
    mine = F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(at))
    out = docs.join(groups.where("taken = n"), mine, "left_semi")
    cut = groups.where("taken < n").first()
    return out if cut is None else out.union(docs.join(groups.where("taken < n"), mine, "left_semi").limit(cut["taken"]))
