"""Prompt context from ranked evidence, and checks of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

TEMPLATE = "qa-1"
SYSTEM = "Answer from the numbered sources only. Name the sources that you use."
NO_CONTEXT_ANSWER = "No source in the index fits this question."


def page_label(start: Column, end: Column) -> Column:
    one = F.coalesce(start.cast("string"), F.lit("unknown"))
    two = F.coalesce(end.cast("string"), F.lit("unknown"))
    return F.when(start == end, start.cast("string")).otherwise(F.concat(one, F.lit("-"), two))


def source_blocks(hits: DataFrame) -> DataFrame:
    """Adds block: the text of a hit under a line with its rank, chunk, document and pages."""
    head = F.format_string("[%d] chunk %s, document %s, pages %s", F.col("rank"), F.col("chunk_id"), F.col("source_document_id"),
        page_label(F.col("page_start"), F.col("page_end")))
    return hits.withColumn("block", F.concat(head, F.lit("\n"), F.col("text")))


def pack_context(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, rank, tokens, used_tokens, kept, error) for each hit.

    queries: (query_id, fixed_tokens, context_window_tokens, max_output_tokens); blocks: (query_id, rank, tokens). Hits
    are taken in rank order up to the first that doesn't fit. error: question_too_large or no_source_fits.
    """
    budget = F.floor(F.col("context_window_tokens") * 90 / 100) - F.col("max_output_tokens")
    rows = blocks.select("query_id", "rank", "tokens").join(queries.withColumn("budget", budget), "query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    used = F.col("fixed_tokens") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("used_tokens", used)
    rows = rows.withColumn("kept", F.col("used_tokens") <= F.col("budget"))
    error = F.when((F.col("budget") <= 0) | (F.col("fixed_tokens") > F.col("budget")),
        "question_too_large").when(F.first("tokens").over(order.rowsBetween(Window.unboundedPreceding,
        Window.unboundedFollowing)) + F.col("fixed_tokens") > F.col("budget"), "no_source_fits")
    return rows.select("query_id", "rank", "tokens", "used_tokens", "kept", error.alias("error"))


def build_prompts(queries: DataFrame, blocks: DataFrame, packed: DataFrame) -> DataFrame:
    """Rows (query_id, template, system_text, user_text): the question, then the kept blocks in order."""
    kept = blocks.join(packed.where("kept and error is null").select("query_id", "rank"), ["query_id", "rank"])
    text = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]),
        "\n\n").alias("sources"))
    return queries.join(text, "query_id").select("query_id", F.lit(TEMPLATE).alias("template"), F.lit(SYSTEM).alias("system_text"),
        F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\n"), F.col("sources")).alias("user_text"))


def no_context_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Fixed answers for the questions without a hit."""
    rows = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    zero = [F.lit(0).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return rows.select("query_id", F.lit(NO_CONTEXT_ANSWER).alias("answer_text"), F.lit("no_context").alias("finish_reason"), *zero,
        F.lit(False).alias("provider_called"))


def validate_context(context: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (query_id, valid): whether the used chunks (query_id, ordinal from 1, chunk_id) are the first of the ranking."""
    ranked = hits.select("query_id", F.col("rank").alias("ordinal"), F.col("chunk_id").alias("expected"))
    rows = context.join(ranked, ["query_id", "ordinal"],
        "left").groupBy("query_id").agg(F.count_if(~F.col("chunk_id").eqNullSafe(F.col("expected"))).alias("wrong"),
        F.max("ordinal").alias("high"), F.count("*").alias("n"), F.count_distinct("ordinal").alias("places"))
    return rows.select("query_id", ((F.col("wrong") == 0) & (F.col("high") == F.col("n")) & (F.col("places") == F.col("n"))).alias("valid"))


def validate_answers(raw: DataFrame) -> DataFrame:
    """Stripped answers with reject_code: empty_answer, missing_finish_reason, invalid_token_count, blank_provenance."""
    code = F.when(is_blank(F.col("answer_text")), "empty_answer").when(is_blank(F.col("finish_reason")), "missing_finish_reason")
    negative = F.lit(False)
    for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
        negative = negative | F.coalesce(F.col(c) < 0, F.lit(False))
    code = code.when(negative, "invalid_token_count").when(F.col("provider_model").isNotNull() & is_blank(F.col("provider_model")), "blank_provenance")
    return raw.withColumn("reject_code", code).withColumn("answer_text", strip(F.col("answer_text")))
