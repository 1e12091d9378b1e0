"""Question sets: normal form, labels by file name, warnings, summaries and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip


def normalize_examples(examples: DataFrame) -> DataFrame:
    """Stripped questions without the blank ones; a blank reference answer is null."""
    rows = examples.withColumn("question", strip(F.col("question"))).where("question <> ''")
    return rows.withColumn("reference_answer", F.nullif(strip(F.col("reference_answer")), F.lit("")))


def _occurrences(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """Each label of an example with the number of documents of its name in the corpus, and one of their ids.

    Names are counted before the join: a name that many documents share is one row.
    """
    names = documents.groupBy("corpus_id", F.col("original_filename").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("document_id"))
    rows = examples.select("example_id", "corpus_id", F.posexplode("relevant_documents").alias("position", "supplied")).withColumn("name",
        strip(F.col("supplied")))
    return rows.join(names, ["corpus_id", "name"], "left")


def resolve_labels(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (example_id, document_id, position): labels that name exactly one document, once each."""
    return _occurrences(examples, documents).where("n = 1 and name <> ''").groupBy("example_id", "document_id").agg(F.min("position").alias("position"))


def label_warnings(examples: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (example_id, position, supplied, code) for each label that can't be used."""
    code = F.when(is_blank(F.col("name")) | F.col("n").isNull(), "document_not_found").when(F.col("n") > 1, "ambiguous_document_name")
    return _occurrences(examples, documents).withColumn("code", code).where("code is not null").select("example_id", "position", "supplied", "code")


def dataset_summary(datasets: DataFrame, corpora: DataFrame, examples: DataFrame, labels: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row for each dataset with its counts, newest first."""
    of = examples.select("example_id", "dataset_id")
    n = lambda df, name: df.join(of, "example_id").groupBy("dataset_id").agg(F.count("*").alias(name))
    counts = examples.groupBy("dataset_id").agg(F.count_distinct("example_id").alias("example_count"))
    names = corpora.select(F.col("id").alias("corpus_id"), F.col("name").alias("corpus_name"))
    rows = datasets.join(names, "corpus_id").withColumnRenamed("id", "dataset_id")
    for part in (counts, n(labels, "label_count"), n(warnings, "warning_count")):
        rows = rows.join(part, "dataset_id", "left")
    return rows.fillna(0, ["example_count", "label_count", "warning_count"]).orderBy(F.desc("created_at"), F.desc("dataset_id"))


def dataset_detail(examples: DataFrame, labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Examples with their labels as an array, by file name and id."""
    named = labels.join(documents.select(F.col("id").alias("document_id"), "original_filename"), "document_id")
    lists = named.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("original_filename", "document_id"))).alias("labels"))
    return examples.join(lists, "example_id", "left").withColumn("labels", F.coalesce("labels", F.array()))


def search(df: DataFrame, text_cols: list[str], text: str | None = None, exact: dict[str, object] | None = None) -> DataFrame:
    """Rows whose columns hold the text, ignoring case, and equal the exact values; a blank text is no filter."""
    for name, value in (exact or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    wanted = (text or "").strip().lower()
    return df.where(F.contains(F.lower(F.concat_ws(" ", *text_cols)), F.lit(wanted))) if wanted else df


def examples_by_warning(examples: DataFrame, warnings: DataFrame, mode: str = "all") -> DataFrame:
    """All examples, only those with a warning ("warned"), or only those without ("clean")."""
    if mode == "all":
        return examples
    return examples.join(warnings.select("example_id").distinct(), "example_id", {"warned": "left_semi", "clean": "left_anti"}[mode])


def unreferenced_datasets(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Datasets that no run uses."""
    return datasets.join(runs.select(F.col("dataset_id").alias("id")).distinct(), "id", "left_anti")


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
