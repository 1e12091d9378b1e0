"""Ordered lists of any length as rows of bounded size: the documents of a corpus, the questions of an evaluation.

A list is cut into segments of `size` items, numbered from 0, each with the keys of its first and last item. A page of it is
read from a key on, from the one or two segments that it lies in. The list itself is never one row, and no task numbers it:
rows are sorted by ranges of (owner, order), and the ranges' counts give each the number of the owner's rows before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import fresh

#: Rows of a range, about.
RANGE_ROWS = 1 << 20


def segments(rows: DataFrame, owner: str, order: Sequence[str], size: int = 1000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (owner, segment, n, first, last, items): items are structs of all other columns, in order; first and last have the
    columns of the order, which tells an owner's rows apart; rows that are equal in it stay in any order."""
    if size < 1:
        raise ValueError("size must be positive")
    part, place, base = fresh(rows.columns, "part", "place", "base")
    parts = max(1, math.ceil(rows.count() / range_rows))
    ranged = materialize(rows.repartitionByRange(parts, owner, *order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(owner).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of an owner
    bases = ranged.groupBy(owner, part).agg(F.count("*").alias("n")).select(F.col(owner).alias("of"), F.col(part).alias("in"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    inside = F.row_number().over(Window.partitionBy(owner, part).orderBy(*order)) - 1
    numbered = ranged.withColumn(place, inside).join(bases, F.col(owner).eqNullSafe(F.col("of")) & (F.col(part) == F.col("in")))
    whole = (F.col(base) + F.col(place)).cast("long")
    item = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != owner))
    kept = numbered.select(F.col(owner), F.floor(whole / size).alias("segment"), F.struct(whole.alias("place"), item.alias("item")).alias("x"))
    key = lambda x: F.struct(*(x[c].alias(c) for c in order))
    listed = kept.groupBy(owner, "segment").agg(F.sort_array(F.collect_list("x")).alias("x"))
    items = F.transform("x", lambda x: x["item"])
    return listed.select(owner, "segment", F.size("x").alias("n"), key(F.element_at("x", 1)["item"]).alias("first"),
        key(F.element_at("x", -1)["item"]).alias("last"), items.alias("items"))


def page(made: DataFrame, owner: str, value: object, count: int, after: Sequence[object] | None = None) -> DataFrame:
    """The next `count` items of an owner after a key (values of the order), or its first ones, in order."""
    of = F.col(owner).eqNullSafe(F.lit(value))
    names = made.schema["last"].dataType.names
    beyond = lambda x: _after([x[n] for n in names], after)
    found = made.where(of) if after is None else made.where(of & beyond(F.col("last")))
    # full segments but the first and the last one, so that count + 1 of them are enough whatever their size
    near = found.orderBy("segment").limit(count + 1).select("segment", F.posexplode("items").alias("place", "item"))
    near = near if after is None else near.where(beyond(F.col("item")))
    return near.orderBy("segment", "place").limit(count).select("item.*")


def _after(columns: list[Column], values: Sequence[object]) -> Column:
    """Whether columns come after values, first column first."""
    column, value = columns[0], F.lit(values[0])
    rest = F.lit(False) if len(columns) == 1 else (column == value) & _after(columns[1:], values[1:])
    return (column > value) | rest


def document_segments(documents: DataFrame, parses: DataFrame, size: int = 1000) -> DataFrame:
    """The documents of each corpus in order of upload: items (uploaded_at, id, original_filename, character_count), the last
    one null where a document is unparsed."""
    own = documents.select("corpus_id", "uploaded_at", "id", "original_filename")
    read = parses.select(F.col("document_id").alias("id"), "character_count")
    return segments(own.join(read, "id", "left").select("corpus_id", "uploaded_at", "id", "original_filename", "character_count"), "corpus_id", ["uploaded_at", "id"], size)


def evaluation_segments(questions: DataFrame, size: int = 1000) -> DataFrame:
    """The questions of each evaluation with their evidence, in dataset order: items (ordinal, example_id, evidence)."""
    return segments(questions.select("evaluation_id", "ordinal", "example_id", "evidence"), "evaluation_id", ["ordinal", "example_id"], size)


def example_segments(labels: DataFrame, documents: DataFrame, size: int = 1000) -> DataFrame:
    """The labels of each example by file name and id: items (original_filename, document_id)."""
    named = labels.select("example_id", "document_id").join(documents.select(F.col("id").alias("document_id"), "original_filename"), "document_id")
    return segments(named.select("example_id", "original_filename", "document_id"), "example_id", ["original_filename", "document_id"], size)
