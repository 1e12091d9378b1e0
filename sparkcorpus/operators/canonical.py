"""Canonical text of documents from pages and blocks, with exact offsets in code points.

Windows go by document: the blocks of one document are bounded by its text. All of them share one shuffle by document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, slice_by_offsets, strip

#: Fixed limit of a document's text.
MAX_TEXT_BYTES = 52_428_800
SEPARATOR = "\n\n"
_page = ("document_id", "page_number")


def _joined(order: tuple[str, ...], text: str, separator: str, keep=None) -> Column:
    items = F.array_sort(F.collect_list(F.struct(*order, text)))
    texts = F.transform(items, lambda x: x[text])
    return F.array_join(texts if keep is None else F.filter(texts, keep), separator)


def reading_order(blocks: DataFrame) -> DataFrame:
    """Non-blank layout blocks, stripped, with reading_order from 0 in each page: by (y0, x0, source_index)."""
    place = Window.partitionBy(*_page).orderBy("y0", "x0", "source_index")
    kept = blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return kept.withColumn("reading_order", F.row_number().over(place) - 1)


def table_rows_to_blocks(cells: DataFrame) -> DataFrame:
    """Rows (document_id, table_index, row_index, text): the non-empty cells of a table row."""
    text = F.regexp_replace(strip(F.col("text")), "\n", " | ")
    rows = cells.withColumn("text", text).groupBy("document_id", "table_index",
        "row_index").agg(_joined(("col_index",), "text", " | ", lambda x: x != "").alias("text"))
    return rows.where("text <> ''")


def page_text(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, page_number, text, has_blocks): blocks joined, or the page's own text where there is none."""
    own = blocks.withColumn("text", strip(F.col("text"))).where("text <> ''").groupBy(*_page).agg(_joined(("block_index",), "text", SEPARATOR).alias("joined"))
    return pages.select(*_page, "text").join(own, [*_page], "left").select(*_page, F.coalesce("joined", "text").alias("text"),
        F.col("joined").isNotNull().alias("has_blocks"))


def canonical_text(texts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rows (document_id, text): non-empty page texts in order; a document without pages keeps its own text."""
    paged = texts.groupBy("document_id").agg(_joined(("page_number",), "text", SEPARATOR, lambda x: F.length(x) > 0).alias("paged"))
    if documents is None:
        return paged.withColumnRenamed("paged", "text")
    return documents.select("document_id", "text").join(paged, "document_id", "left").select("document_id", F.coalesce("paged", "text").alias("text"))


def page_offsets(texts: DataFrame) -> DataFrame:
    """Rows (document_id, page_number, start, end). A separator goes before a non-empty page if any page before it has text."""
    order = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("text").cast("long")
    filled = F.sum(F.when(size > 0, 1).otherwise(0)).over(order)
    end = F.sum(size).over(order) + F.length(F.lit(SEPARATOR)) * F.greatest(filled - 1, F.lit(0))
    return texts.select(*_page, (end - size).alias("start"), end.alias("end"))


def block_offsets(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, page_number, block_index, ordinal, start, end, text) of the non-blank blocks."""
    inside = Window.partitionBy(*_page).orderBy("block_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("document_id").orderBy("page_number", "block_index")
    kept = blocks.withColumn("text", strip(F.col("text"))).where("text <> ''")
    size = F.length("text").cast("long")
    local = F.sum(size).over(inside) + 2 * (F.count("*").over(inside) - 1)
    kept = kept.select(*_page, "block_index", "text", (local - size).alias("from"), local.alias("to"), (F.row_number().over(whole) - 1).alias("ordinal"))
    starts = page_offsets(texts).select(*_page, F.col("start").alias("page_start"))
    return kept.join(starts, [*_page]).select(*_page, "block_index", "ordinal", (F.col("page_start") + F.col("from")).alias("start"),
        (F.col("page_start") + F.col("to")).alias("end"), "text")


def broken_json(parts: DataFrame, columns: Sequence[str] = ("metadata", "bounding_box")) -> DataFrame:
    """Ids of the documents with a page or block whose metadata or box isn't JSON. A box may be null."""
    broken = reduce(lambda a, b: a | b, (F.col(c).isNotNull() & F.try_parse_json(c).isNull() for c in columns))
    return parts.where(broken).select("document_id").distinct()


def validate_parses(parses: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Adds reject_code: the first rule that a parse fails, or null. warnings are checked where there is such a column.

    broken: rows (document_id) of the parses whose pages or blocks have metadata that isn't JSON.
    """
    json_ok = F.try_parse_json("metadata").isNotNull()
    if "warnings" in parses.columns:
        json_ok = json_ok & (F.col("warnings").isNull() | F.try_parse_json("warnings").isNotNull())
    if broken is not None:
        marked = broken.select("document_id").distinct().withColumn("broken_part", F.lit(True))
        parses = parses.join(marked, "document_id", "left")
        json_ok = json_ok & F.col("broken_part").isNull()
    code = (
        F.when(is_blank(F.col("parser_name")) | is_blank(F.col("parser_version")), "invalid_parser_output")
        .when(is_blank(F.col("text")), "empty_parsed_document")
        .when(F.octet_length("text") > MAX_TEXT_BYTES, "parsed_document_too_large")
        .when(~json_ok, "invalid_parser_output")
    )
    return parses.withColumn("reject_code", code).drop("broken_part")


def parse_stats(parses: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, utf8_size_bytes, character_count, page_count, block_count)."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    sized = parses.select("document_id", F.octet_length("text").cast("long").alias("utf8_size_bytes"), F.length("text").cast("long").alias("character_count"))
    return sized.join(count(pages, "page_count"), "document_id", "left").join(count(blocks, "block_count"), "document_id", "left").fillna(0,
        ["page_count", "block_count"])


def page_warnings(pages: DataFrame) -> DataFrame:
    """Rows (document_id, warnings): one message for each blank page, in order."""
    blank = pages.where(is_blank(F.col("text"))).groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("n"))
    return blank.select("document_id", F.transform("n", lambda x: F.format_string("Page %d has no text", x)).alias("warnings"))


def parsed_documents(parses: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, text, pages): pages by number, each with its blocks by ordinal. pages and blocks have offsets."""
    inner = blocks.groupBy(*_page).agg(F.array_sort(F.collect_list(F.struct("ordinal", "start", "end"))).alias("blocks"))
    outer = pages.join(inner, [*_page], "left").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "start", "end",
        F.coalesce("blocks", F.array()).alias("blocks")))).alias("pages"))
    return parses.select("document_id", "text").join(outer, "document_id", "left").select("document_id", "text", F.coalesce("pages", F.array()).alias("pages"))


def slice_text(parses: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds body = text[start:end) to rows (document_id, start, end, ...)."""
    return ranges.join(parses.select("document_id", F.col("text").alias("__text")), "document_id").withColumn("body",
        slice_by_offsets(F.col("__text"), F.col("start"), F.col("end"))).drop("__text")
