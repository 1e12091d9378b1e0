"""Scores of retrieval and of judged answers, with coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from .questions import latest

RETRIEVAL_METRICS = ("hit_rate", "recall", "mrr")
USAGE = ("prompt_tokens", "completion_tokens", "total_tokens")
ANSWER_METRICS = ("answer_correctness", "groundedness", "answer_relevance")
JUDGMENT = "struct<metric:string,score:int,rationale:string,evidence_ranks:array<int>>"


def _matches(labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Hits up to rank k with whether their document is a label. hits: (example_id, rank, document_id)."""
    known = labels.select("example_id", "document_id").distinct().withColumn("match", F.lit(True))
    return hits.where(F.col("rank") <= k).join(known, ["example_id", "document_id"], "left")


def score_retrieval(questions: DataFrame, labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Rows (example_id, hit_rate, recall, mrr, skipped_reason) for each question; those without labels have no score."""
    found = _matches(labels, hits, k).where("match").groupBy("example_id").agg(F.min("rank").alias("first"), F.count_distinct("document_id").alias("found"))
    total = labels.groupBy("example_id").agg(F.count_distinct("document_id").alias("labels"))
    rows = questions.select("example_id").join(total, "example_id", "left").join(found, "example_id", "left")
    score = lambda value: F.when(F.col("labels").isNotNull(), F.coalesce(value, F.lit(0.0)))
    return rows.select("example_id", score(F.when(F.col("first").isNotNull(), 1.0)).alias("hit_rate"),
        score(F.col("found") / F.col("labels")).alias("recall"), score(1.0 / F.col("first")).alias("mrr"),
        F.when(F.col("labels").isNull(), "no_resolved_document_labels").alias("skipped_reason"))


def retrieval_evidence(questions: DataFrame, labels: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Rows (example_id, matching_ranks, ranked_documents, labels)."""
    ordered = lambda items, field: F.transform(F.array_sort(items), lambda x: x[field])
    ranked = _matches(labels, hits, k).groupBy("example_id").agg(F.array_sort(F.collect_list(F.when(F.col("match"),
        F.col("rank")))).alias("matching_ranks"), ordered(F.collect_list(F.struct("rank", "document_id")), "document_id").alias("ranked_documents"))
    own = labels.groupBy("example_id").agg(F.sort_array(F.collect_set("document_id")).alias("labels"))
    rows = questions.select("example_id").join(ranked, "example_id", "left").join(own, "example_id", "left")
    return rows.select("example_id", *(F.coalesce(c, F.array()).alias(c) for c in ("matching_ranks", "ranked_documents", "labels")))


def coverage(scores: DataFrame) -> DataFrame:
    """Rows (metric, mean_score, total, eligible, scored, skipped, errors) from rows (metric, score, status)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return scores.groupBy("metric").agg(F.avg(F.when(F.col("status") == "scored", F.col("score"))).alias("mean_score"),
        F.count("*").alias("total"), (n("scored") + n("error")).alias("eligible"), n("scored").alias("scored"), n("skipped").alias("skipped"),
        n("error").alias("errors"))


def aggregate_retrieval(scores: DataFrame, metrics: tuple[str, ...] = RETRIEVAL_METRICS) -> DataFrame:
    long = scores.unpivot(["example_id"], list(metrics), "metric", "score")
    return coverage(long.withColumn("status", F.when(F.col("score").isNull(), "skipped").otherwise("scored")))


def evaluation_inputs(example_runs: DataFrame, examples: DataFrame, answers: DataFrame, labels: DataFrame, hits: DataFrame, chunks: DataFrame,
    context: DataFrame) -> DataFrame:
    """One row for each example of a run, in its order, with all that its scores need."""
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    texts = chunks.select("chunk_id", "document_id", "text")
    ranked = hits.join(texts.select("chunk_id", "document_id"), "chunk_id").groupBy("example_run_id").agg(ordered("rank",
        "document_id").alias("ranked_documents"))
    used = context.join(texts.select("chunk_id", "text"), "chunk_id").groupBy("example_run_id").agg(ordered("ordinal", "text").alias("context_texts"))
    own = labels.groupBy("example_id").agg(F.sort_array(F.collect_set("document_id")).alias("labels"))
    rows = example_runs.select("example_run_id", "example_id", "ordinal").join(examples.select("example_id", "question", "reference_answer"),
        "example_id").join(answers.select("example_run_id", "answer_text"), "example_run_id", "left")
    rows = rows.join(own, "example_id", "left").join(ranked, "example_run_id", "left").join(used, "example_run_id", "left")
    return rows.select("example_run_id", "example_id", "ordinal", "question", "reference_answer", "answer_text",
        *(F.coalesce(c, F.array()).alias(c) for c in ("labels", "ranked_documents", "context_texts")))


def answer_eligibility(inputs: DataFrame, metrics: tuple[str, ...] = ANSWER_METRICS) -> DataFrame:
    """Rows (example_id, metric, eligible, skipped_reason); the metrics are a short fixed list."""
    none = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rows = inputs.withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    reason = F.when(none("answer_text"), "no_generated_answer").when((F.col("metric") == "answer_correctness") & none("reference_answer"),
        "no_reference_answer")
    return rows.select("example_id", "metric", reason.isNull().alias("eligible"), reason.alias("skipped_reason"))


def judge_requests(inputs: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Rows (example_id, metrics, context_size, request): one JSON request for each question with an eligible metric."""
    asked = eligibility.where("eligible").groupBy("example_id").agg(F.sort_array(F.collect_list("metric")).alias("metrics"))
    rows = inputs.join(asked, "example_id")
    ranked = F.transform("context_texts", lambda text, i: F.struct((i + 1).alias("rank"), text.alias("text")))
    body = F.struct(F.col("answer_text").alias("answer"), ranked.alias("context"), "metrics", "question", "reference_answer")
    return rows.select("example_id", "metrics", F.size("context_texts").alias("context_size"), F.to_json(body, {"ignoreNullFields": "false"}).alias("request"))


def parse_judgments(replies: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows (example_id, metric, rubric_score, score, rationale, evidence_ranks, error) and the tokens that a reply used: a
    reply is valid as a whole or not at all.

    replies: (example_id, reply); requests: (example_id, metrics, context_size). Rubric scores are 0 to 4, scores 0 to 1.
    Token counts that aren't integers of 0 or more are null.
    """
    rows = requests.select("example_id", "metrics", "context_size").join(replies.select("example_id", "reply"), "example_id", "left")
    items = F.from_json(F.get_json_object("reply", "$.results"), f"array<{JUDGMENT}>")
    raw = F.from_json(F.get_json_object("reply", "$.results"), "array<map<string,string>>")
    inside = lambda x: F.forall(x["evidence_ranks"], lambda r: F.coalesce((r >= 1) & (r <= F.col("context_size")), F.lit(False)))
    fine = lambda x: F.coalesce(x["score"].between(0,
        4) & ~is_blank(x["rationale"]) & (F.length(x["rationale"]) <= 1000) & x["evidence_ranks"].isNotNull() & ((x["metric"] != "groundedness") | inside(x)), F.lit(False))
    whole = F.coalesce(F.forall(raw, lambda x: F.coalesce(x["score"].rlike(r"^-?\d+$"), F.lit(False))), F.lit(False))
    names = F.transform("items", lambda x: x["metric"])
    valid = F.coalesce((F.sort_array(names) == F.sort_array("metrics")) & F.forall("items", fine) & whole, F.lit(False))
    used = lambda name: F.get_json_object("reply", f"$.usage.{name}")
    tokens = {name: F.when(used(name).rlike(r"^\d+$"), F.expr(f"try_cast(get_json_object(reply, '$.usage.{name}') as bigint)")) for name in USAGE}
    rows = rows.withColumns({"items": items, "valid": valid} | tokens)
    none, no_ranks = F.lit(None), F.array().cast("array<int>")
    ranks = F.when(F.col("x.metric") == "groundedness", F.col("x.evidence_ranks")).otherwise(no_ranks)
    good = rows.where("valid").select("example_id", F.explode("items").alias("x"), *USAGE).select(
        "example_id", "x.metric", F.col("x.score").alias("rubric_score"), (F.col("x.score") / 4).alias("score"),
        strip(F.col("x.rationale")).alias("rationale"), ranks.alias("evidence_ranks"), none.cast("string").alias("error"), *USAGE,
    )
    bad = rows.where("not valid").select(
        "example_id", F.explode("metrics").alias("metric"), none.cast("int").alias("rubric_score"), none.cast("double").alias("score"),
        none.cast("string").alias("rationale"), no_ranks.alias("evidence_ranks"), F.lit("invalid_evaluator_response").alias("error"), *USAGE,
    )
    return good.unionByName(bad)


def aggregate_answers(eligibility: DataFrame, judgments: DataFrame) -> DataFrame:
    """As aggregate_retrieval, with has_errors."""
    rows = eligibility.join(judgments.select("example_id", "metric", "score", "error"), ["example_id", "metric"], "left")
    status = F.when(~F.col("eligible"), "skipped").when(F.col("error").isNotNull() | F.col("score").isNull(), "error").otherwise("scored")
    return coverage(rows.withColumn("status", status)).withColumn("has_errors", F.col("errors") > 0)


def evaluation_status(covered: DataFrame, by: str = "evaluation_id") -> DataFrame:
    """Rows (by, status, eligible_count, total_count): failed if something was eligible and nothing was scored."""
    rows = covered.groupBy(by).agg(F.sum("scored").alias("scored"), F.max("eligible").alias("eligible_count"), F.max("total").alias("total_count"))
    return rows.select(by, F.when((F.col("eligible_count") > 0) & (F.col("scored") == 0), "failed").otherwise("completed").alias("status"),
        "eligible_count", "total_count")


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    """The newest attempt of each run; ties go to the one inserted last (seq)."""
    return latest(evaluations, ["run_id"], [F.desc("created_at"), F.desc("seq")])


def evaluation_detail(evaluations: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts with the evidence of their questions as an array, in dataset order."""
    listed = questions.groupBy("evaluation_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "example_id", "evidence"))).alias("questions"))
    return evaluations.join(listed, "evaluation_id", "left")


