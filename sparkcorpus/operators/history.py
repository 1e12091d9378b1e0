"""Runs: what can be launched, expansion, summaries, the list of runs and the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import matched
from .questions import latest

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")


def compatible_inputs(indexes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows (index_id, dataset_id, launchable, reason) for the pairs of one corpus."""
    reason = F.when(F.col("status") != "ready", "index_not_ready").when(F.col("vector_index_id").isNull(), "no_vector_index")
    own = indexes.select(F.col("id").alias("index_id"), "corpus_id", reason.isNull().alias("launchable"), reason.alias("reason"))
    pairs = matched(own, datasets.select(F.col("id").alias("dataset_id"), "corpus_id"), "corpus_id")
    return pairs.select("index_id", "dataset_id", "launchable", "reason")


def launch_checks(requests: DataFrame, indexes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows (index_id, dataset_id, launchable, reason) for requested pairs, also those of unknown or different corpora."""
    own = indexes.select(F.col("id").alias("index_id"), "corpus_id", "status", "vector_index_id")
    other = datasets.select(F.col("id").alias("dataset_id"), F.col("corpus_id").alias("dataset_corpus"), F.lit(True).alias("known"))
    rows = requests.join(own, "index_id", "left").join(other, "dataset_id", "left")
    reason = (
        F.when(F.col("status").isNull() | F.col("known").isNull(),
            "unknown_input").when((F.col("status") != "ready") | F.col("vector_index_id").isNull(), "index_not_ready")
        .when(F.col("corpus_id") != F.col("dataset_corpus"), "different_corpora")
    )
    return rows.select("index_id", "dataset_id", reason.isNull().alias("launchable"), reason.alias("reason"))


def expand_runs(runs: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows (run_id, example_id, ordinal, status, total_examples): one pending row for each question of a run's dataset."""
    own = runs.select(F.col("id").alias("run_id"), "dataset_id")
    pairs = matched(own, examples.select("dataset_id", "example_id", "ordinal"), "dataset_id", n_right="total_examples")
    return pairs.select("run_id", "example_id", "ordinal", F.lit("pending").alias("status"), "total_examples")


def runs_without_examples(runs: DataFrame, examples: DataFrame) -> DataFrame:
    return runs.join(examples.select("dataset_id").distinct(), "dataset_id", "left_anti")


def run_summary(runs: DataFrame, example_runs: DataFrame, indexes: DataFrame | None = None, datasets: DataFrame | None = None,
    evaluations: DataFrame | None = None) -> DataFrame:
    """One row for each run, newest first. example_runs has its retrieval and generation on the row, null where missing.

    Tokens that aren't known are left out of the sums and counted apart. Examples are summed before the join. indexes and
    datasets (id, name) give a run the names of its index_id and dataset_id, evaluations (run_id, id, status, created_at,
    seq) its latest evaluation.
    """
    for part, name in ((indexes, "index"), (datasets, "dataset")):
        if part is not None:
            runs = runs.join(part.select(F.col("id").alias(f"{name}_id"), F.col("name").alias(f"{name}_name")), f"{name}_id", "left")
    if evaluations is not None:
        last = latest(evaluations, ["run_id"], [F.desc("created_at"), F.desc("seq")])
        last = last.select(F.col("run_id").alias("of"), F.col("id").alias("latest_evaluation_id"), F.col("status").alias("latest_evaluation_status"))
        runs = runs.join(last, runs["id"] == last["of"], "left").drop("of")
    n = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_examples")
    sums = [x for c in USAGE for x in (F.sum(c).alias(c), F.count(c).alias(f"known_{c}"))]
    of = example_runs.groupBy("run_id").agg(n("failed"), n("pending"), n("running"), F.count("retrieval_ms").alias("retrieval_results"),
        F.count("generation_ms").alias("generation_results"), F.avg("retrieval_ms").alias("mean_retrieval_ms"),
        F.avg("generation_ms").alias("mean_generation_ms"), *sums)
    counts = ["failed_examples", "pending_examples", "running_examples", "retrieval_results", "generation_results", *(f"known_{c}" for c in USAGE)]
    return runs.join(of, runs["id"] == of["run_id"], "left").drop("run_id").fillna(0, counts).orderBy(F.desc("created_at"), F.desc("id"))


def run_detail(runs: DataFrame, example_runs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each example of a run, by run and ordinal, with its hits by rank, which top k bounds; a run without
    examples is one row. hits: (example_run_id, rank, chunk_id, document_name, start, end)."""
    ranked = hits.groupBy("example_run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_name", "start", "end"))).alias("hits"))
    rows = example_runs.select("run_id", "ordinal", "example_run_id", F.col("status").alias("example_status")).join(ranked, "example_run_id",
        "left").withColumn("hits", F.coalesce("hits", F.array()))
    return runs.join(rows, runs["id"] == rows["run_id"], "left").drop("run_id").orderBy("id", "ordinal", "example_run_id")


def run_history(summary: DataFrame, now: str, text: str | None = None, status: str | None = None, index_id: str | None = None,
    dataset_id: str | None = None, days: int | None = None, sort: str = "newest", page: int = 1, size: int = 20) -> DataFrame:
    """One page of the runs. summary: (id, index_id, index_name, dataset_id, dataset_name, status, created_at, started_at, duration_ms, completed_examples, total_examples)."""
    at = F.lit(now).cast("timestamp")
    running = (F.unix_millis(at) - F.unix_millis("started_at")).cast("long")
    rows = summary.withColumn("status", F.when(F.col("status") == "pending", "queued").otherwise(F.col("status")))
    rows = rows.withColumn("elapsed_ms", F.when(F.col("status") == "running", running).otherwise(F.col("duration_ms")))
    rows = rows.withColumn("elapsed_seconds", F.floor(F.col("elapsed_ms") / 1000)).withColumn("percent",
        F.when(F.col("total_examples") > 0, F.floor(100 * F.col("completed_examples") / F.col("total_examples") + 0.5)).otherwise(0).cast("long"))
    if wanted := (text or "").strip().lower():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "id", "index_name", "dataset_name")), F.lit(wanted)))
    for name, value in (("status", status), ("index_id", index_id), ("dataset_id", dataset_id)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if days is not None:
        rows = rows.where((F.unix_millis(at) - F.unix_millis("created_at")) < days * 86_400_000)
    newest = [F.desc("created_at"), F.desc("id")]
    order = {"newest": newest, "oldest": [F.asc("created_at"), F.asc("id")], "longest": [F.desc_nulls_last("elapsed_ms"), *newest]}[sort]
    page = min(max(page, 1), max(-(-rows.count() // size), 1))
    rows = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    # only the rows of the page are numbered
    position = F.row_number().over(Window.orderBy(*order)) + (page - 1) * size
    return rows.withColumn("position", position).withColumn("page", F.lit(page))


def status_counts(runs: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return runs.agg(F.count("*").alias("total"), n("running", "queued", "pending").alias("active"), n("completed").alias("completed"),
        n("failed").alias("failed"))


def filter_examples(examples: DataFrame, status: str | None = None, text: str | None = None) -> DataFrame:
    """Questions of a run, in order."""
    rows = examples if status is None else examples.where(F.col("status") == status)
    if wanted := (text or "").strip().lower():
        rows = rows.where(F.contains(F.lower("question"), F.lit(wanted)))
    return rows.orderBy("run_id", "ordinal")


def example_status_counts(examples: DataFrame) -> DataFrame:
    return examples.groupBy("run_id", "status").agg(F.count("*").alias("examples"))


def pending_backlog(prepared: DataFrame, runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Pending work of three kinds, oldest first."""
    rows = None
    for kind, df in (("evaluation", evaluations), ("preparation", prepared), ("run", runs)):
        part = df.where("status = 'pending'").select("created_at", F.lit(kind).alias("kind"), "id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy("created_at", "kind", "id")


def prepared_index_list(prepared: DataFrame, chunk_sets: DataFrame, vector_indexes: DataFrame, status: str | None = None) -> DataFrame:
    """Prepared indexes with the counts of their parts and the status of both stages."""
    rows = prepared if status is None else prepared.where(F.col("status") == status)
    rows = rows.join(chunk_sets.select(F.col("id").alias("chunk_set_id"), "chunk_count"), "chunk_set_id",
        "left").join(vector_indexes.select(F.col("id").alias("vector_index_id"), "vector_count"), "vector_index_id", "left")
    stage = lambda ref, name: F.when(F.col(ref).isNotNull(), "completed").when((F.col("status") == "failed") & (F.col("stage") == name),
        "failed").when((F.col("status") == "running") & (F.col("stage") == name), "running").otherwise("pending")
    return rows.withColumn("chunking_status", stage("chunk_set_id", "chunking")).withColumn("embedding_status", stage("vector_index_id", "embedding"))


def corpus_inventory(corpora: DataFrame, documents: DataFrame, parses: DataFrame) -> DataFrame:
    """Rows (corpus_id, name, documents, parsed, characters), newest first; empty corpora are kept."""
    of = documents.join(parses.select("document_id", "character_count"), documents["id"] == F.col("document_id"), "left")
    counts = of.groupBy("corpus_id").agg(F.count("*").alias("documents"), F.count("character_count").alias("parsed"),
        F.sum("character_count").alias("characters"))
    rows = corpora.select(F.col("id").alias("corpus_id"), F.col("name"), "created_at").join(counts, "corpus_id", "left").fillna(0, ["documents", "parsed"])
    return rows.orderBy(F.desc("created_at"), F.desc("corpus_id"))


def corpus_documents(corpora: DataFrame, documents: DataFrame, parses: DataFrame) -> DataFrame:
    """Corpora with their documents in order of upload; parse fields are null where a document is unparsed."""
    of = documents.join(parses.select("document_id", "character_count"), documents["id"] == F.col("document_id"), "left")
    lists = of.groupBy("corpus_id").agg(F.array_sort(F.collect_list(F.struct("uploaded_at", "id", "original_filename", "character_count"))).alias("documents"))
    return corpora.withColumnRenamed("id", "corpus_id").join(lists, "corpus_id", "left").withColumn("documents", F.coalesce("documents", F.array()))


