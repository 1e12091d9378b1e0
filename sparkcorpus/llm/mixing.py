"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. A target of t over a source of s words means floor(t / s) complete epochs of
all its documents, then a weighted sample without replacement for the rest: a document gets the exponential key
-ln(u) / quality weight, the documents of a source are taken by rising key, and a running sum of sizes stops at the
budget. u comes from the document's id, so reruns agree.

Keys, sums and windows are built-in functions. The running sum is made in two steps, so that one source with most of
the rows isn't one task: keys are cut into buckets, sums of buckets give the base of each, and rows are summed inside
their bucket only. Buckets are made from counts of cells of a few hundredths of a key's size, so they are about equal
whatever the weights; only rows with one and the same key can't be parted.

Edge cases: a null text has size 0 and a null source is a source of its own, last in order. A document of size 0 is never
taken. A very long text is one document, which may fill a target. Equal keys are ordered by id and then by a hash of the
text; repeated ids share their key and are handled as separate rows. `mixed_documents` goes by id and text: rows equal in
both share the copies that fall on them, evenly, the odd ones by chance that depends on their place in the input. Other
columns are not read. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, split_words, uniform

#: Rows that one bucket of keys holds, about.
BUCKET_ROWS = 4096
#: Cells for each factor e of the keys.
CELLS = 32


def n_words(text: str) -> Column:
    return F.size(split_words(F.coalesce(F.col(f"`{text}`"), F.lit("")))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, n_docs, source_size, target) from rows (source, size).

    Sources by code point, null last, have the weights in turn. They share `share` times all words by weight; a target
    stops at `most` times its source, and the excess is shared again until none is above. That end has a closed form:
    the capped sources are those with the least cap for their weight, and the others share what is left.
    """
    each = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before),
        F.lit(0.0))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # from the first source on that isn't capped, every source gets this level for its weight
    each = each.withColumn("level", F.min(F.when(F.col("cap") * F.col("w_left") >= F.col("left") * F.col("w"),
        F.struct(F.col("cap") / F.col("w"), F.col("left") / F.col("w_left")))).over(every))
    return each.select("source", "n_docs", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap",
        F.col("level.col2") * F.col("w"))).alias("target"))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None) -> DataFrame:
    """Rows (id, h, source, size, weight), h being a hash of the text. quality: rows (id, weight), one for an id; without
    one a document weighs 1."""
    text = F.xxhash64(F.col(f"`{text_col}`")).alias("h")
    sizes = docs.select(F.col(f"`{id_col}`").alias("id"), text, F.col(f"`{source_col}`").alias("source"), n_words(text_col).alias("size"))
    if quality is None:
        return sizes.withColumn("weight", F.lit(1.0))
    quality = quality.select(F.col("id").alias("of"), F.col("weight").cast("double").alias("weight"))
    return sizes.join(quality, F.col("id") == F.col("of"), "left").select("id", "h", "source", "size", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def mix(sizes: DataFrame, targets: DataFrame, seed: str = "mix", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (id, h, size, source_size, target, taken) for rows (id, h, source, size, weight).

    The document on the edge of the budget is taken for the words that are left, so a source's taken words are its
    target, rounded.
    """
    key = -F.log(uniform("id", seed=seed)) / F.greatest(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(1e-9))
    # keys are spread evenly inside a cell, whatever the weights
    height = F.log("key") * CELLS
    rows = sizes.select("id", "h", "source", "size", key.alias("key")).withColumn("cell", F.floor(height)).withColumn("within", height - F.col("cell"))
    cells = rows.groupBy("source", "cell").agg(F.ceil(F.count("*") / bucket_rows).alias("pieces"))
    cells = cells.select(F.col("source").alias("of"), F.col("cell").alias("at"), "pieces")
    rows = rows.join(_small(cells), F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    rows = rows.withColumn("piece", F.floor(F.col("within") * F.col("pieces")))
    targets = targets.withColumnRenamed("source", "of")
    rows = rows.join(_small(targets), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bucket = ("source", "cell", "piece")
    sums = rows.groupBy(*bucket).agg(F.sum("size").alias("sum"))
    base = F.sum("sum").over(Window.partitionBy("source").orderBy("cell", "piece")) - F.col("sum")
    bases = sums.select(F.col("source").alias("of"), F.col("cell").alias("of_cell"), F.col("piece").alias("of_piece"), base.alias("base"))
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell")) & (F.col("piece") == F.col("of_piece")))
    inside = Window.partitionBy(*bucket).orderBy("key", "id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("base") + F.sum("size").over(inside) - F.col("size")
    epochs = F.coalesce(F.floor(F.try_divide(F.round("target"), F.col("source_size"))), F.lit(0))
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - before))
    return rows.select("id", "h", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, to be broadcast if it has so few rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None,
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows (id, h, size, source_size, target, taken) for all rows of docs."""
    sizes = materialize(sizes_of(docs, id_col, text_col, source_col, quality))
    return mix(sizes, materialize(source_targets(sizes, weights, share, most)), seed)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as often as the mix takes them, whole: the document on the edge counts if half of it or more is taken."""
    taken = mix_sources(docs, id_col, text_col, source_col, **options).where("taken > 0")
    wholes = F.round(F.col("taken") / F.col("size"))
    of, at, copies, rows, text, each, again = fresh(docs, "of", "at", "copies", "rows", "text", "each", "again")
    shares = taken.groupBy(F.col("id").alias(of), F.col("h").alias(at)).agg(F.sum(wholes).alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    mine = docs.withColumn(text, F.xxhash64(F.col(f"`{text_col}`"))).withColumn(each,
        F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30))
    found = mine.join(shares.hint("shuffle_hash"), F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.col(text) == F.col(at)))
    share = F.col(copies) / F.col(rows)
    times = (F.floor(share) + F.when(F.col(each) < share - F.floor(share), 1).otherwise(0)).cast("int")
    return found.where(times > 0).withColumn(again, F.explode(F.sequence(F.lit(1), times))).select(*(f"`{c}`" for c in docs.columns))
