"""What the training-text operators share: the word rule, batching of texts, lineage cuts, components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; written for Java, Python and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Text is handed to vectorised code in slices of about so many bytes, so that memory doesn't follow the Arrow batch.
SLICE_BYTES = 4 << 20
#: Narrow rows, as edges, are read again in tasks of about so many.
TASK_ROWS = 1 << 14


def split_words(text: Column) -> Column:
    """The words of a text. Where blanks and line ends are its only white space, as is usual, no pattern is needed."""
    return F.array_remove(split_pieces(text), "")


def split_pieces(text: Column) -> Column:
    """As split_words, with empty pieces among the words."""
    odd = reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"))
    blanks = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.split(blanks, F.when(odd, F.lit(SPACE)).otherwise(F.lit(" ")))


def _checkpoint_folder(spark: SparkSession) -> None:
    """See that there is a checkpoint folder. Only a local master may use a folder of its own machine."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Actions on DataFrames made in here remove their shuffle files when they end. Else these stay until the driver collects
    garbage, and a job of many small steps fills the disk with them. A choice of the session stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(key, None) == "true":
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder of spark.checkpoint.dir."""
    _checkpoint_folder(df.sparkSession)
    with swept(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, which takes the setting


def settled(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Like materialize, for narrow rows: read again in tasks of about so many rows, one at least. A small table is else read
    by as many tasks as a shuffle has partitions, and each of them writes files for every shuffle after."""
    out = materialize(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    _checkpoint_folder(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Like materialize, as a table of Parquet files: smaller, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back_memory() -> None:
    """Return what was freed to the system: a worker process goes on to other tasks, and would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


@contextmanager
def bounded_batches(spark: SparkSession, most: int = SLICE_BYTES) -> Iterator[None]:
    """Actions in here hand rows to Python in batches of about `most` bytes, one row at least; a limit of the session stays.

    Else a batch is 10,000 rows, whatever their length, and a task holds it several times over: both sides build it by doubling.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches with about `most` bytes of text each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    give_back_memory()


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of many texts at once: index of each word in the distinct words, those words, and offsets by text.

    A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends - ends[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():
        flat, ends = flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, ends


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(codes: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each position on. The last width - 1 positions of a text run into the next one."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    words, n = hashes[codes], len(codes) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[j : j + n]
    return mix(out)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, highest bit first."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        block = hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return total


def majority(sums: np.ndarray, n: int) -> int:
    """The unsigned fingerprint whose bits are those set in over half of n hashes."""
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def uniform(*columns, seed: str = "") -> F.Column:
    """A number in (0, 1) that depends on the columns alone, by MD5, so that any engine can repeat it."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sampled(rows: DataFrame, share: Column, most: int, by: str | None = None) -> DataFrame:
    """Rows (text, by, copies): `most` of the rows (id, text, by) at most, for each value of `by`, with equal texts as one.

    Every row with a text is as likely as any other, equal ones too: they are told apart by their place in the input. So
    the sample is bounded and in proportion whatever the copies. share: so many of the rows make up `most`, about; twice
    as many are drawn, and of those the first ones by hash stay.
    """
    drawn = rows.where(F.col("text").isNotNull()).withColumn("u", F.xxhash64("id", "text", F.monotonically_increasing_id()))
    drawn = materialize(drawn.where(F.pmod("u", F.lit(1_000_003)) < F.greatest(2 * share * 1_000_003, F.lit(1))).drop("id"))
    if by is None:
        return drawn.orderBy("u").limit(most).groupBy("text").agg(F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("u"))
    return drawn.withColumn("place", place).where(F.col("place") <= most).groupBy("text", by).agg(F.count("*").alias("copies"))


def repeats(copies: np.ndarray, most: int) -> np.ndarray:
    """Indexes of items, each as often as it has copies; scaled down, to once at least, if there are over `most` copies."""
    scale = min(1.0, most / max(int(copies.sum()), 1))
    return np.repeat(np.arange(len(copies)), np.maximum(1, np.round(copies * scale).astype(np.int64)))


def both_ways(edges: DataFrame) -> DataFrame:
    """The edges (a, b), each from both ends. One task's edges stay in one task, so that what follows needs no shuffle for them."""
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("e")).select("e.a", "e.b")


def connected_components(edges: DataFrame, most: int = 64) -> DataFrame:
    """Rows (node, root) for every node of the undirected edges (a, b): root is the smallest node that is reachable.

    Fails if no two rounds agree in `most` rounds, rather than giving roots that aren't the smallest.

    Large-star and small-star steps in turn (Kiveris et al., 2014). A step is a minimum by key, combined before the
    shuffle, and a join that Spark can split at a hot key; nothing is collected by node. Each round is checkpointed.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)

    def state(edges: DataFrame) -> tuple[int, int | None]:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    tasks = -(-before[0] // TASK_ROWS) or 1  # no step adds edges
    edges = edges.coalesce(tasks)
    for _ in range(most):
        both = both_ways(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a",
            F.col("m").alias("b")))
        edges = materialize(small.coalesce(tasks).distinct())
        now = state(edges)
        edges = edges.coalesce(-(-now[0] // TASK_ROWS) or 1)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def dense(rows: DataFrame, bits: int) -> DataFrame:
    """One row (v): the numbers `v` of rows (at, v) in the order of `at`, 2**bits of them; places without a row are 0."""
    zeros = rows.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("at"), F.lit(0).cast(rows.schema["v"].dataType).alias("v"))
    entries = rows.select("at", "v").union(zeros).groupBy("at").agg(F.bit_or("v").alias("v"))
    parts = entries.groupBy(F.shiftright("at", 10).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("own"))
    parts = parts.select("part", F.transform("own", lambda x: x["v"]).alias("own"))
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("part", "own"))).alias("parts"))
    return whole.select(F.flatten(F.transform("parts", lambda x: x["own"])).alias("v"))


def bits_for(n: int, least: int, most: int) -> int:
    """Exponent of the table size for n entries, within bounds."""
    return min(most, max(least, math.ceil(math.log2(max(n, 1) * 16))))


def perhaps(keys: DataFrame, most: int = 27) -> Column:
    """Whether a row's columns, named as those of `keys`, may be one of the keys: a test on a table of up to 2**most bits.

    No key is missed. With more than 2**(most - 4) keys more rows pass that aren't among them.
    """
    bits = bits_for(keys.count(), 10, most)
    slot = F.shiftrightunsigned(F.xxhash64(*(f"`{c}`" for c in keys.columns)), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))
    table = materialize(dense(keys.select(F.shiftright(slot, 6).cast("int").alias("at"), one.alias("v")), bits - 6)).scalar()
    word = F.element_at(table, (F.shiftright(slot, 6) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
