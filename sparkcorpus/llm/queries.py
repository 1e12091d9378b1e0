"""One query for each operator over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, importance, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secrets, token_counts, token_files, vector_graph
from .common import materialize, shared_folder
from .sql import ORACLE_SQL

#: The vocabulary of op9, and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: The two tokenizers that op12 aligns.
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.matches(table(spark, sf_dir, "documents")).selectExpr("id AS doc_id", "line", "first_id AS first_doc_id", "first_line", "n_links")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's repository is its source in its language, and its owner is the source
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), repo_col=F.concat_ws("/", "source", "lang"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), "n_live", "n_examples")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def quality_weights(labels: DataFrame) -> DataFrame:
    """Rows (id, weight) from labels: good documents weigh 2, bad ones 0.5."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.when(F.avg("quality") >= 0.5,
        2.0).otherwise(0.5).alias("weight"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), quality=quality_weights(table(spark, sf_dir, "labels")))
    return mixed.drop("h").withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out), id_col="doc_id")
    return language_id.predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four commits: all documents are inserted, then revised (repeated lines go), those labelled toxic are
    deleted, and the revision is committed again, which changes nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = token_counts.Ledger(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    loaded = materialize(token_counts.counted(docs))
    revised = materialize(token_counts.counted(docs.withColumn("text", F.array_join(F.array_distinct(F.split("text", "\n")), "\n"))))
    ledger.commit("1-load", token_counts.inserts(loaded))
    ledger.commit("2-revise", token_counts.changes(loaded, revised))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    ledger.commit("3-delete", token_counts.deletes(revised.join(toxic, "id", "left_semi")))
    ledger.commit("2-revise", token_counts.changes(loaded, revised))
    return ledger.totals()


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.statistics(table(spark, sf_dir, "documents"), a, b).withColumnRenamed("id", "doc_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
