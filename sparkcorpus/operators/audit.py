"""Audits of tables: rows without parent, repeated keys, broken rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fresh

_STATUS = "status in ('pending', 'running', 'completed', 'failed')"
_METRIC = "distance_metric in ('cosine', 'dot_product', 'euclidean')"
_CHARACTERS = {"start_offset": "character_start_offset >= 0", "offsets": "character_end_offset >= character_start_offset"}


def _text(*columns: str) -> dict[str, str]:
    return {f"{c}_not_blank": f"length(trim({c})) > 0" for c in columns}


def _from(least: int, *columns: str) -> dict[str, str]:
    return {f"{c}_from_{least}": f"{c} >= {least}" for c in columns}


def _json(kind: str | None, *columns: str) -> dict[str, str]:
    """kind: first character of the JSON text, after blanks, where the type is fixed."""
    starts = lambda c: f" and startswith(ltrim({c}), '{kind}')" if kind else ""
    return {f"{c}_json": f"{c} is null or (try_parse_json({c}) is not null{starts(c)})" for c in columns}


#: Checks of the data model by table: name -> SQL expression that holds for a good row. Fixed values.
RULES: dict[str, dict[str, str]] = {
    "document": _from(0, "size_bytes"),
    "document_parse": _text("normalized_text", "parser_name", "parser_version") | _from(1, "utf8_size_bytes", "character_count") | _from(0,
        "page_count", "block_count", "duration_ms")
    | _json("{", "document_metadata_json") | _json("[", "warnings_json"),
    "parsed_page": _from(1, "page_number") | _CHARACTERS | _json("{", "metadata_json"),
    "parsed_block": _from(0, "ordinal", "source_block_index") | _CHARACTERS | _json("{", "metadata_json") | _json(None, "bounding_box_json"),
    "chunk_set": {"status": "status in ('pending', 'running', 'ready', 'failed')"} | _from(0, "chunk_count", "duration_ms"),
    "chunk": _from(0, "ordinal", "token_start_offset") | _from(1,
        "page_start") | _CHARACTERS | {"tokens": "token_end_offset >= token_start_offset", "pages": "page_end >= page_start"},
    "vector_index": _text("provider", "model") | _from(1, "dimensions", "vector_count") | _from(0, "duration_ms") | {"metric": _METRIC,
        "status": "status = 'ready'"} | _json("{", "embedding_config_json"),
    "prepared_index": _text("name") | _from(0, "chunking_duration_ms", "embedding_duration_ms", "duration_ms") | _json("{",
        "effective_config_json", "error_details_json") | {
        "name_length": "length(name) <= 100", "status": "status in ('pending', 'running', 'ready', 'failed')",
            "stage": "current_stage in ('chunking', 'embedding')",
        "running": "status <> 'running' or (started_at is not null and current_stage is not null)",
        "ready": "status <> 'ready' or (chunk_set_id is not null and vector_index_id is not null and chunk_set_reused is not null and vector_index_reused is not null"
        " and chunking_duration_ms is not null and embedding_duration_ms is not null and current_stage is null and started_at is not null and completed_at is not null and duration_ms is not null)",
        "failed": "status <> 'failed' or (current_stage is null and started_at is not null and completed_at is not null and duration_ms is not null and error_code is not null)",
    },
    "evaluation_dataset": _text("name", "source_filename") | {"name_length": "length(name) <= 100",
        "sha256": "length(source_sha256) = 64"} | _json("[", "import_warnings_json"),
    "evaluation_example": _from(0, "ordinal") | _text("question"),
    "benchmark_run": _from(1, "total_examples") | _from(0, "completed_examples", "duration_ms") | _json("{", "effective_config_json", "error_details_json")
    | {"status": _STATUS, "stage": "current_stage in ('retrieval', 'generation')", "progress": "completed_examples <= total_examples"},
    "benchmark_example_run": _from(0, "ordinal", "retrieval_duration_ms", "generation_duration_ms", "duration_ms") | _json("{", "error_details_json")
    | {"status": _STATUS, "stage": "current_stage in ('retrieval', 'generation')"},
    "benchmark_retrieval_result": _from(1, "requested_top_k") | _from(0,
        "duration_ms") | {"returned": "returned_count between 0 and requested_top_k", "metric": _METRIC},
    "benchmark_retrieved_chunk": _from(1, "rank"),
    "benchmark_generation_result": _text("provider", "model", "answer_text", "finish_reason") | _from(0, "prompt_tokens", "completion_tokens",
        "total_tokens", "duration_ms") | _json(None, "generation_config_json"),
    "benchmark_generation_context_chunk": _from(1, "ordinal", "retrieval_rank"),
    "retrieval_evaluation": {"status": _STATUS} | _json(None, "config_json", "aggregate_json", "coverage_json"),
    "retrieval_evaluation_question": _json(None, "result_json"),
}

#: References of the data model: (child, child column, parent), to the parent's id, or by the columns given. Fixed values.
REFERENCES: tuple[tuple[str, dict[str, str], str], ...] = tuple((child, {column: "id"}, parent) for child, column, parent in (
    ("document", "corpus_id", "corpus"), ("document_parse", "document_id", "document"), ("parsed_page", "parse_id", "document_parse"),
        ("parsed_block", "parse_id", "document_parse"),
    ("chunk_set", "corpus_id", "corpus"), ("chunk", "chunk_set_id", "chunk_set"), ("chunk", "source_document_id", "document"),
        ("vector_index", "chunk_set_id", "chunk_set"),
    ("prepared_index", "corpus_id", "corpus"), ("prepared_index", "chunk_set_id", "chunk_set"), ("prepared_index", "vector_index_id", "vector_index"),
    ("evaluation_dataset", "corpus_id", "corpus"), ("evaluation_example", "dataset_id", "evaluation_dataset"),
    ("evaluation_example_relevant_document", "example_id", "evaluation_example"), ("evaluation_example_relevant_document", "document_id", "document"),
    ("benchmark_run", "prepared_index_id", "prepared_index"), ("benchmark_run", "dataset_id", "evaluation_dataset"), ("benchmark_run", "corpus_id", "corpus"),
    ("benchmark_run", "vector_index_id", "vector_index"), ("benchmark_run", "current_example_id", "evaluation_example"),
    ("benchmark_example_run", "benchmark_run_id", "benchmark_run"), ("benchmark_example_run", "evaluation_example_id", "evaluation_example"),
    ("benchmark_retrieval_result", "example_run_id", "benchmark_example_run"), ("benchmark_retrieval_result", "vector_index_id", "vector_index"),
    ("benchmark_retrieved_chunk", "retrieval_result_id", "benchmark_retrieval_result"), ("benchmark_retrieved_chunk", "chunk_id", "chunk"),
    ("benchmark_generation_result", "example_run_id", "benchmark_example_run"),
        ("benchmark_generation_result", "retrieval_result_id", "benchmark_retrieval_result"),
    ("benchmark_generation_context_chunk", "generation_result_id", "benchmark_generation_result"),
    ("retrieval_evaluation", "benchmark_run_id", "benchmark_run"), ("retrieval_evaluation_question", "evaluation_id", "retrieval_evaluation"),
        ("retrieval_evaluation_question", "example_id", "evaluation_example"),
)) + (
    ("parsed_block", {"page_id": "id", "parse_id": "parse_id"}, "parsed_page"),
    ("benchmark_generation_context_chunk", {"retrieval_result_id": "retrieval_result_id", "retrieval_rank": "rank"}, "benchmark_retrieved_chunk"),
)

#: Unique keys of the data model besides `id`, by table. Fixed values.
UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "document": (("storage_path",),), "document_parse": (("document_id",),), "parsed_page": (("parse_id", "page_number"), ("id", "parse_id")),
        "parsed_block": (("parse_id", "ordinal"),),
    "chunk_set": (("fingerprint",),), "chunk": (("chunk_set_id", "source_document_id", "ordinal"),), "vector_index": (("fingerprint",), ("collection_name",)),
    "evaluation_example": (("dataset_id", "ordinal"),), "evaluation_example_relevant_document": (("example_id", "document_id"),),
    "benchmark_example_run": (("benchmark_run_id", "evaluation_example_id"), ("benchmark_run_id", "ordinal")),
        "benchmark_retrieval_result": (("example_run_id",),),
    "benchmark_retrieved_chunk": (("retrieval_result_id", "rank"), ("retrieval_result_id", "chunk_id")),
        "benchmark_generation_result": (("example_run_id",), ("retrieval_result_id",)),
    "benchmark_generation_context_chunk": (("generation_result_id", "ordinal"), ("generation_result_id", "retrieval_rank")),
        "retrieval_evaluation_question": (("evaluation_id", "example_id"),),
}


#: Every column that a rule reads, for the audit of tables that have some of them only.
ALL_COLUMNS = set("""size_bytes normalized_text parser_name parser_version utf8_size_bytes character_count page_count block_count duration_ms document_metadata_json warnings_json page_number
    character_start_offset character_end_offset metadata_json ordinal source_block_index bounding_box_json status chunk_count token_start_offset token_end_offset page_start page_end provider model
    dimensions vector_count distance_metric embedding_config_json name chunking_duration_ms embedding_duration_ms effective_config_json error_details_json current_stage started_at completed_at
    chunk_set_id vector_index_id chunk_set_reused vector_index_reused error_code source_filename source_sha256 import_warnings_json question total_examples completed_examples
    retrieval_duration_ms generation_duration_ms requested_top_k returned_count rank answer_text finish_reason prompt_tokens completion_tokens total_tokens generation_config_json retrieval_rank
    config_json aggregate_json coverage_json result_json""".split())  # fmt: skip


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child whose non-null key (child column -> parent column) isn't in parent."""
    names = dict(zip(keys, fresh(child.columns, *(f"known_{c}" for c in keys)), strict=True))
    known = parent.select(*(F.col(p).alias(names[c]) for c, p in keys.items())).distinct()
    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys))
    return child.where(there).join(known, reduce(lambda a, b: a & b, (F.col(c) == F.col(names[c]) for c in keys)), "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def rule_violations(df: DataFrame, rules: dict[str, str], key: list[str]) -> DataFrame:
    """Rows (key, rule) for each rule that a row breaks; an unknown result breaks no rule. One pass for all rules."""
    broken = F.array_compact(F.array(*(F.when(~F.expr(rule), name) for name, rule in rules.items())))
    return df.select(*key, F.explode(broken).alias("rule"))


#: What a fact says of a check: a row breaks a rule, has a unique key, refers to a key, or has a key that others refer to.
BREAKS, HAS, REFERS, IS = range(4)


def _key(columns: Sequence[str]) -> Column:
    """Columns as one text; null where one of them is."""
    return F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), F.to_json(F.array(*(F.col(c).cast("string") for c in columns))))


def audit_model(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (table, rule, broken): how many rows of each table break each declared check, reference and unique key (keys that
    occur more than once).

    Each table is read once: a row is turned into facts, one for each check that it breaks, each unique key that it has, and
    each reference that it makes or serves. Facts of all tables are counted by (check, key) in one aggregate, with sums before
    the shuffle, so that a key that very many rows refer to is a row for each task; what is broken follows from the counts.
    Keys are compared as text. Tables and columns that aren't there are passed over.
    """
    checks: list[tuple[str, str]] = []
    facts: dict[str, list[Column]] = {name: [] for name in tables}

    def fact(table: str, what: int, kind: int, key: Column) -> None:
        row = F.struct(F.lit(what).alias("what"), F.lit(kind).cast("tinyint").alias("kind"), key.alias("key"))
        facts[table].append(F.when(key.isNotNull(), row))

    for name, df in tables.items():
        have = set(df.columns)
        for rule, test in RULES.get(name, {}).items():
            if set(re.findall(r"[a-z_0-9]+", re.sub("'[^']*'", "", test))) & ALL_COLUMNS <= have:
                fact(name, len(checks), BREAKS, F.when(~F.expr(test), ""))
                checks.append((name, rule))
        for keys in (("id",), *UNIQUE_KEYS.get(name, ())):
            if set(keys) <= have:
                fact(name, len(checks), HAS, _key(keys))
                checks.append((name, f"unique {', '.join(keys)}"))
    for child, keys, parent in REFERENCES:
        if child in tables and parent in tables and set(keys) <= set(tables[child].columns) and set(keys.values()) <= set(tables[parent].columns):
            fact(child, len(checks), REFERS, _key([*keys]))
            fact(parent, len(checks), IS, _key([*keys.values()]))
            checks.append((child, f"{', '.join(keys)} in {parent}"))
    said = [df.select(F.explode(F.array_compact(F.array(*facts[name]))).alias("f")).select("f.*") for name, df in tables.items() if facts[name]]
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(i, *c) for i, c in enumerate(checks)], "what int, table string, rule string")
    if not said:
        return listed.select("table", "rule", F.lit(0).cast("long").alias("broken"))
    kind = F.col("kind")
    counted = reduce(DataFrame.unionByName, said).groupBy("what", "key").agg(F.count_if(kind == BREAKS).alias("breaks"),
        F.count_if(kind == HAS).alias("has"), F.count_if(kind == REFERS).alias("refers"), F.count_if(kind == IS).alias("is"))
    broken = F.col("breaks") + F.when(F.col("has") > 1, 1).otherwise(0) + F.when(F.col("is") == 0, F.col("refers")).otherwise(0)
    sums = counted.groupBy("what").agg(F.sum(broken).alias("broken"))  # one row for each check
    return listed.join(F.broadcast(sums), "what", "left").select("table", "rule", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))
