"""Queries over context packing, question sets, evaluations, runs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, chunking, context, evaluation, history, questions
from .queries import query
from .views import Tables

# --- context -----------------------------------------------------------------------------------------------------
# A conversation is a query and each of its turns a hit, in order.

_TURNS = r"""hits AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, CAST(turn + 1 AS INT) AS rank, conv_id || '-' || turn AS chunk_id,
    role AS source_document_id, CASE WHEN turn % 3 > 0 THEN turn END AS page_start, CASE WHEN turn % 4 > 0 THEN turn + turn % 2 END AS page_end, text,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens
    FROM conversations)"""
_BLOCK = "'[' || rank || '] chunk ' || chunk_id || ', document ' || source_document_id || ', pages ' || CASE WHEN page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE coalesce(CAST(page_start AS VARCHAR), 'unknown') || '-' || coalesce(CAST(page_end AS VARCHAR), 'unknown') END || chr(10) || text"
_PACK = f"""WITH {_TURNS}, used AS (SELECT *, 10 + sum(tokens) OVER (PARTITION BY query_id
    ORDER BY rank) AS used_tokens, first_value(tokens) OVER (PARTITION BY query_id
    ORDER BY rank) AS first FROM hits), packed AS (SELECT query_id, rank, tokens, CAST(used_tokens AS BIGINT) AS used_tokens,
    used_tokens <= 80 AS kept, CASE WHEN first + 10 > 80 THEN 'no_source_fits' END AS error
    FROM used)"""


def _turns(t: Tables) -> DataFrame:
    turn = F.col("turn")
    return t["conversations"].select(
        F.col("conv_id").cast("string").alias("query_id"), (turn + 1).cast("int").alias("rank"),
            F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("source_document_id"),
        F.when(turn % 3 > 0, turn).alias("page_start"), F.when(turn % 4 > 0, turn + turn % 2).alias("page_end"), "text",
            chunking.token_count(F.col("text")).alias("tokens"),
    )


def _asked(t: Tables) -> DataFrame:
    return t["conversations"].select(F.col("conv_id").cast("string").alias("query_id")).distinct().select("query_id",
        F.concat(F.lit("What of "), "query_id", F.lit("?")).alias("question"), F.lit(10).alias("fixed_tokens"),
        F.lit(100).alias("context_window_tokens"), F.lit(10).alias("max_output_tokens"))


@query(f"WITH {_TURNS} SELECT query_id, rank, md5({_BLOCK}) AS block FROM hits")
def f1_source_blocks(t: Tables) -> DataFrame:
    return context.source_blocks(_turns(t)).select("query_id", "rank", F.md5("block").alias("block"))


@query(_PACK + " SELECT * FROM packed")
def f2_packed_context(t: Tables) -> DataFrame:
    return context.pack_context(_turns(t), _asked(t))


@query(_PACK + f""" SELECT h.query_id, 'qa-1' AS template, md5('Question: What of ' || h.query_id || '?' || chr(10) || chr(10)
    || string_agg({_BLOCK.replace('rank', 'h.rank')}, chr(10) || chr(10)
    ORDER BY h.rank)) AS user_text FROM hits h JOIN packed p ON p.query_id = h.query_id AND p.rank = h.rank
    WHERE kept AND error IS NULL GROUP BY h.query_id""")
def f3_prompts(t: Tables) -> DataFrame:
    blocks, asked = context.source_blocks(_turns(t)), _asked(t)
    return context.build_prompts(asked, blocks, context.pack_context(blocks, asked)).select("query_id", "template", F.md5("user_text").alias("user_text"))


@query("""SELECT DISTINCT CAST(conv_id AS VARCHAR) AS query_id, 'no_context' AS finish_reason, 0 AS total_tokens, false AS provider_called
    FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations
    WHERE turn >= 4)""")
def f4_no_context_answers(t: Tables) -> DataFrame:
    return context.no_context_answers(_asked(t), _turns(t).where("rank > 4")).select("query_id", "finish_reason", "total_tokens", "provider_called")


@query("SELECT CAST(conv_id AS VARCHAR) AS query_id, bool_and(role <> 'assistant' OR turn % 5 <> 3) AS valid FROM conversations GROUP BY conv_id")
def f5_context_checks(t: Tables) -> DataFrame:
    used = _turns(t).select("query_id", F.col("rank").alias("ordinal"),
        F.when((F.col("source_document_id") == "assistant") & ((F.col("rank") - 1) % 5 == 3), "other").otherwise(F.col("chunk_id")).alias("chunk_id"))
    return context.validate_context(used, _turns(t))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'empty_answer' WHEN 1 THEN 'missing_finish_reason' WHEN 2 THEN 'invalid_token_count'
    WHEN 3 THEN 'blank_provenance' END AS reject_code, CASE WHEN doc_id % 6 = 0 THEN '' ELSE md5(regexp_replace(text, '^\\s+|\\s+$', '',
    'g')) END AS answer_text
    FROM documents""")
def f6_answer_checks(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = t["documents"].select("doc_id", F.when(k == 0, "  ").otherwise(F.concat(F.lit("\n"), "text", F.lit(" "))).alias("answer_text"),
        F.when(k == 1, " ").otherwise("stop").alias("finish_reason"), F.when(k == 2, -1).when(k == 4, None).otherwise(5).alias("prompt_tokens"),
        F.lit(1).alias("completion_tokens"), F.lit(6).alias("total_tokens"), F.when(k == 3, " ").alias("provider_model"))
    return context.validate_answers(raw).select("doc_id", "reject_code",
        F.when(F.col("answer_text") == "", "").otherwise(F.md5("answer_text")).alias("answer_text"))


# --- question sets -----------------------------------------------------------------------------------------------
# A document asks about the files of two others in its corpus: some names are ambiguous, some unknown.

_EXAMPLES = """ex AS (SELECT id AS example_id, corpus_id, corpus_id AS dataset_id, [original_filename, ' doc_' || (uploaded_at + 20) % 390 || '.txt ',
    'none.txt', ''] AS names
    FROM docs), occ AS (SELECT example_id, corpus_id, unnest(range(4)) AS position, unnest(names) AS supplied
    FROM ex), cnt AS (SELECT corpus_id, original_filename AS name, count(*) AS n, min(id) AS document_id
    FROM docs GROUP BY ALL), res AS (SELECT o.*, c.n, c.document_id
    FROM occ o LEFT JOIN cnt c ON c.corpus_id = o.corpus_id AND c.name = trim(o.supplied)),
    lab AS (SELECT example_id, document_id, min(position) AS position
    FROM res WHERE n = 1 GROUP BY ALL), warn AS (SELECT example_id, position, supplied, CASE WHEN n IS NULL THEN 'document_not_found'
    ELSE 'ambiguous_document_name' END AS code
    FROM res WHERE n IS NULL OR n > 1)"""


def _examples(t: Tables) -> DataFrame:
    other = F.concat(F.lit(" doc_"), ((F.col("uploaded_at") + 20) % 390).cast("string"), F.lit(".txt "))
    return t["docs"].select(F.col("id").alias("example_id"), "corpus_id", F.col("corpus_id").alias("dataset_id"),
        F.array(F.col("original_filename"), other, F.lit("none.txt"), F.lit("")).alias("relevant_documents"))


@query("""SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS question, CASE WHEN doc_id % 2 = 0 THEN source END AS reference_answer
    FROM documents WHERE doc_id % 9 <> 0""")
def g1_normal_examples(t: Tables) -> DataFrame:
    raw = t["documents"].select("doc_id", F.when(F.col("doc_id") % 9 == 0, "　\n").otherwise(F.concat(F.lit(" "), "text",
        F.lit("\n"))).alias("question"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\t"), "source")).otherwise(" ").alias("reference_answer"))
    return questions.normalize_examples(raw).withColumn("question", F.md5("question"))


@query(f"WITH {_EXAMPLES} SELECT example_id, document_id, CAST(position AS INT) AS position FROM lab", "docs")
def g2_resolved_labels(t: Tables) -> DataFrame:
    return questions.resolve_labels(_examples(t), t["docs"])


@query(f"WITH {_EXAMPLES} SELECT example_id, CAST(position AS INT) AS position, supplied, code FROM warn", "docs")
def g3_label_warnings(t: Tables) -> DataFrame:
    return questions.label_warnings(_examples(t), t["docs"])


@query(f"""WITH {_EXAMPLES} SELECT dataset_id, 'corpus ' || dataset_id AS corpus_name, count(*) AS example_count, (SELECT count(*)
    FROM lab JOIN ex e ON e.example_id = lab.example_id WHERE e.dataset_id = ex.dataset_id) AS label_count, (SELECT count(*)
    FROM warn JOIN ex e ON e.example_id = warn.example_id WHERE e.dataset_id = ex.dataset_id) AS warning_count
    FROM ex GROUP BY dataset_id""", "docs")
def g4_dataset_summary(t: Tables) -> DataFrame:
    examples, docs = _examples(t), t["docs"]
    datasets = docs.groupBy("corpus_id").agg(F.max("uploaded_at").alias("created_at")).withColumn("id", F.col("corpus_id"))
    corpora = datasets.select("id", F.concat(F.lit("corpus "), "id").alias("name"))
    rows = questions.dataset_summary(datasets, corpora, examples, questions.resolve_labels(examples, docs), questions.label_warnings(examples, docs))
    return rows.select("dataset_id", "corpus_name", "example_count", "label_count", "warning_count")


@query(f"""WITH {_EXAMPLES} SELECT example_id, '[' || coalesce((SELECT string_agg('{{"original_filename":"' || d.original_filename || '","document_id":"' || d.id || '"}}', ',' ORDER BY d.original_filename, d.id)
    FROM lab JOIN docs d ON d.id = lab.document_id WHERE lab.example_id = ex.example_id), '') || ']' AS labels FROM ex""", "docs")
def g5_dataset_detail(t: Tables) -> DataFrame:
    examples = _examples(t)
    found = questions.dataset_detail(examples, questions.resolve_labels(examples, t["docs"]), t["docs"])
    return found.select("example_id", F.to_json("labels").alias("labels"))


@query("SELECT id FROM docs WHERE corpus_id = 'src3' AND contains(lower(original_filename || ' ' || id), 'doc_1')", "docs")
def g6_inventory_search(t: Tables) -> DataFrame:
    return questions.search(t["docs"], ["original_filename", "id"], " DOC_1 ", {"corpus_id": "src3"}).select("id")


@query(f"""WITH {_EXAMPLES}, w AS (SELECT DISTINCT example_id FROM warn
    WHERE code = 'ambiguous_document_name') SELECT example_id, CASE WHEN example_id IN (SELECT example_id
    FROM w) THEN 'warned' ELSE 'clean' END AS mode FROM ex""", "docs")
def g7_examples_by_warning(t: Tables) -> DataFrame:
    examples = _examples(t)
    warnings = questions.label_warnings(examples, t["docs"]).where("code = 'ambiguous_document_name'")
    warned, clean = (questions.examples_by_warning(examples, warnings, m).select("example_id", F.lit(m).alias("mode")) for m in ("warned", "clean"))
    return warned.union(clean)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def g8_unreferenced_datasets(t: Tables) -> DataFrame:
    return questions.unreferenced_datasets(t["customer"].select(F.col("c_custkey").alias("id")),
        t["orders"].where("o_totalprice > 250000").select(F.col("o_custkey").alias("dataset_id")))


# --- evaluations -------------------------------------------------------------------------------------------------
# A document is a question of the evaluation of its source; its language decides what its answer is like.


def _inputs(t: Tables) -> DataFrame:
    return t["docs"].select(F.col("id").alias("example_id"), "corpus_id", F.lit("q").alias("question"),
        F.when(F.col("lang") != "fr", F.col("original_filename")).alias("reference_answer"),
        F.when(F.col("lang") != "de", "answer").alias("answer_text"), F.array(F.lit("one"), F.lit("two")).alias("context_texts"))


_ELIGIBLE = """elig AS (SELECT id AS example_id, corpus_id, metric, NOT (lang = 'de' OR (lang = 'fr' AND metric = 'answer_correctness')) AS eligible,
    CASE WHEN lang = 'de' THEN 'no_generated_answer' WHEN lang = 'fr'
    AND metric = 'answer_correctness' THEN 'no_reference_answer' END AS skipped_reason, uploaded_at
    FROM docs CROSS JOIN (SELECT unnest(['answer_correctness', 'groundedness', 'answer_relevance']) AS metric)),
    judged AS (SELECT *, CASE WHEN uploaded_at % 4 > 0 THEN (uploaded_at % 5) / 4 END AS score, CASE
    WHEN uploaded_at % 4 = 0 THEN 'invalid_evaluator_response' END AS error
    FROM elig WHERE eligible)"""


@query(f"WITH {_ELIGIBLE} SELECT example_id, metric, eligible, skipped_reason FROM elig", "docs")
def h5_answer_eligibility(t: Tables) -> DataFrame:
    return evaluation.answer_eligibility(_inputs(t))


@query(f"""WITH {_ELIGIBLE}, asked AS (SELECT example_id, list(metric ORDER BY metric) AS metrics FROM elig WHERE eligible GROUP BY example_id)
SELECT a.*, 2 AS context_size, '{{"answer":"answer","context":[{{"rank":1,"text":"one"}},{{"rank":2,"text":"two"}}],"metrics":["' || array_to_string(metrics, '","') || '"],"question":"q","reference_answer":'
    || CASE WHEN lang <> 'fr' THEN '"' || original_filename || '"' ELSE 'null' END || '}}' AS request FROM asked a JOIN docs ON id = example_id""", "docs")
def h6_judge_requests(t: Tables) -> DataFrame:
    return evaluation.judge_requests(_inputs(t), evaluation.answer_eligibility(_inputs(t)))


def _judgments(t: Tables) -> DataFrame:
    """Replies to the requests; one in four has a score out of range, a repeated metric, no rationale or a wrong rank."""
    requests = evaluation.judge_requests(_inputs(t),
        evaluation.answer_eligibility(_inputs(t))).join(t["docs"].select(F.col("id").alias("example_id"), "uploaded_at"), "example_id")
    n, bad = F.col("uploaded_at"), F.col("uploaded_at") % 4 == 0
    kind = F.col("uploaded_at") % 16
    item = lambda m: F.struct(F.when(bad & (kind == 4), "groundedness").otherwise(m).alias("metric"),
        F.when(bad & (kind == 0), 9).otherwise(n % 5).alias("score"), F.when(bad & (kind == 8), " ").otherwise(" fine\n").alias("rationale"),
        F.when(bad & (kind == 12), F.array(F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).alias("evidence_ranks"))
    usage = F.struct(F.when(n % 3 == 0, -1).otherwise(n).alias("total_tokens"), F.lit("many").alias("prompt_tokens"), F.lit(True).alias("completion_tokens"))
    return evaluation.parse_judgments(requests.select("example_id", F.to_json(F.struct(F.transform("metrics", item).alias("results"),
        usage.alias("usage"))).alias("reply")), requests)


@query(f"""WITH {_ELIGIBLE} SELECT example_id, metric, CAST(score AS DOUBLE) AS score, CAST(4 * score AS INT) AS rubric_score, CASE
    WHEN error IS NULL THEN 'fine' END AS rationale, error, CASE WHEN error IS NULL AND metric = 'groundedness' THEN 2 ELSE 0 END AS ranks, CASE
    WHEN uploaded_at % 3 > 0 THEN uploaded_at END AS total_tokens
    FROM judged""", "docs")
def h7_judgments(t: Tables) -> DataFrame:
    return _judgments(t).select("example_id", "metric", "score", "rubric_score", "rationale", "error", F.size("evidence_ranks").alias("ranks"), "total_tokens")


_COVERED = """SELECT e.{by}, round(avg(j.score), 6) AS mean_score, count(*) AS total, count(*) FILTER (WHERE e.eligible) AS eligible,
    count(j.score) AS scored, count(*) FILTER (WHERE NOT e.eligible) AS skipped, count(j.error) AS errors, count(j.error) > 0 AS has_errors
    FROM elig e LEFT JOIN judged j ON j.example_id = e.example_id AND j.metric = e.metric
    GROUP BY e.{by}"""


@query(f"WITH {_ELIGIBLE} " + _COVERED.format(by="metric"), "docs")
def h8_answer_summary(t: Tables) -> DataFrame:
    return evaluation.aggregate_answers(evaluation.answer_eligibility(_inputs(t)), _judgments(t)).withColumn("mean_score", F.round("mean_score", 6))


@query("""SELECT l_suppkey AS evaluation_id, CASE WHEN max(q) > 0 AND sum(s) = 0 THEN 'failed' ELSE 'completed' END AS status,
    CAST(max(q) AS BIGINT) AS eligible_count, CAST(max(n) AS BIGINT) AS total_count
    FROM (SELECT l_suppkey, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS q, count(*) FILTER (WHERE l_returnflag = 'A'
    AND l_suppkey % 3 > 0) AS s
    FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def h9_evaluation_status(t: Tables) -> DataFrame:
    covered = t["lineitem"].groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("total"),
        F.count_if(F.col("l_returnflag") != "R").alias("eligible"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 3 > 0)).alias("scored"))
    return evaluation.evaluation_status(covered.withColumnRenamed("l_suppkey", "evaluation_id"))


@query("SELECT o_custkey AS run_id, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS seq FROM orders GROUP BY o_custkey")
def h10_latest_evaluation(t: Tables) -> DataFrame:
    return evaluation.latest_evaluation(t["orders"].select(F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").alias("seq"))).select("run_id", "seq")


@query("""SELECT CAST(event_id AS VARCHAR) AS example_run_id, event_id AS ordinal, event_type AS question, CASE WHEN event_type = 'click' THEN props END AS answer_text
    FROM events""")
def h4_evaluation_inputs(t: Tables) -> DataFrame:
    e = t["events"].select(F.col("event_id").cast("string").alias("example_run_id"), F.col("event_type").alias("example_id"),
        F.col("event_id").alias("ordinal"), "event_type", "props")
    examples = e.select("example_id", F.col("event_type").alias("question"), F.lit(None).cast("string").alias("reference_answer")).distinct()
    labels = examples.select("example_id", F.col("question").alias("document_id"))
    chunks = t["docs"].select(F.col("id").alias("chunk_id"), F.col("corpus_id").alias("document_id"), "text")
    hits = e.select("example_run_id", F.lit(1).alias("rank"), (F.col("ordinal") % 100).cast("string").alias("chunk_id"))
    rows = evaluation.evaluation_inputs(e, examples, e.where("event_type = 'click'").select("example_run_id",
        F.col("props").alias("answer_text")), labels, hits, chunks, hits.withColumnRenamed("rank", "ordinal"))
    return rows.select("example_run_id", "ordinal", "question", "answer_text")


# --- runs --------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS index_id, s_suppkey AS dataset_id, c_mktsegment <> 'BUILDING' AND c_custkey % 10 <> 0 AS launchable, CASE
    WHEN c_mktsegment = 'BUILDING' THEN 'index_not_ready' WHEN c_custkey % 10 = 0 THEN 'no_vector_index' END AS reason
    FROM customer JOIN supplier ON s_nationkey = c_nationkey""")
def i1_launchable_pairs(t: Tables) -> DataFrame:
    indexes = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("corpus_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "running").otherwise("ready").alias("status"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("vector_index_id"))
    return history.compatible_inputs(indexes, t["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("corpus_id")))


@query("""SELECT c_custkey AS run_id, s_suppkey AS example_id, s_suppkey AS ordinal, 'pending' AS status, count(*) OVER (PARTITION BY c_custkey) AS total_examples
    FROM customer JOIN supplier ON s_nationkey = c_nationkey""")
def i2_expanded_runs(t: Tables) -> DataFrame:
    return history.expand_runs(t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset_id")),
        t["supplier"].select(F.col("s_nationkey").alias("dataset_id"), F.col("s_suppkey").alias("example_id"), F.col("s_suppkey").alias("ordinal")))


@query("""SELECT run_id AS id, count(*) FILTER (WHERE status = 'failed') AS failed_examples,
    count(*) FILTER (WHERE status = 'pending') AS pending_examples, count(*) FILTER (WHERE status = 'running') AS running_examples,
    count(retrieval_ms) AS retrieval_results, count(generation_ms) AS generation_results, round(avg(retrieval_ms), 6) AS mean_retrieval_ms,
    round(avg(generation_ms), 6) AS mean_generation_ms, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(tokens) AS known_total_tokens
    FROM example_runs GROUP BY run_id""", "example_runs")
def i3_run_summary(t: Tables) -> DataFrame:
    rows = t["example_runs"].select("*", *(F.col("tokens").alias(c) for c in history.USAGE))
    found = history.run_summary(t["runs"].select("id", "created_at"), rows)
    mean = lambda c: F.round(c, 6).alias(c)
    return found.select("id", "failed_examples", "pending_examples", "running_examples", "retrieval_results", "generation_results",
        mean("mean_retrieval_ms"), mean("mean_generation_ms"), "total_tokens", "known_total_tokens")


@query("""SELECT r.id, r.status, ordinal, e.id AS example_run_id, e.status AS example_status, CASE WHEN e.id IS NULL THEN NULL WHEN ordinal % 3 = 0 THEN '[]' ELSE
    '[{"rank":1,"chunk_id":"b' || question || '","document_name":"n","start":0,"end":1},{"rank":2,"chunk_id":"a' || question
    || '","document_name":"n","start":0,"end":1}]' END AS hits
    FROM runs r LEFT JOIN example_runs e ON e.run_id = r.id""", "runs", "example_runs")
def i4_run_detail(t: Tables) -> DataFrame:
    name = F.element_at(F.array(F.lit("b"), F.lit("a")), F.col("rank"))
    hits = t["events"].where("event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("example_run_id"), "event_type",
        F.explode(F.array(F.lit(2), F.lit(1))).alias("rank"))
    hits = hits.select("example_run_id", "rank", F.concat(name, "event_type").alias("chunk_id"), F.lit("n").alias("document_name"),
        F.lit(0).alias("start"), F.lit(1).alias("end"))
    found = history.run_detail(t["runs"], t["example_runs"].withColumnRenamed("id", "example_run_id"), hits)
    return found.select("id", "status", "ordinal", "example_run_id", "example_status", F.to_json("hits").alias("hits"))


_HISTORY = """WITH h AS (SELECT id, CASE status WHEN 'pending' THEN 'queued' ELSE status END AS status, created_at, CASE
    WHEN status = 'running' THEN 1767225600000 - (1700000000 + created_at * 60) * 1000 ELSE duration_ms END AS elapsed_ms,
    CAST(floor(100 * completed_examples / total_examples + 0.5) AS BIGINT) AS percent
    FROM runs)"""


@query(_HISTORY + """ SELECT id, status, CAST(elapsed_ms AS BIGINT) AS elapsed_ms, CAST(floor(elapsed_ms / 1000) AS BIGINT) AS elapsed_seconds,
    percent, CAST(position AS INT) AS position, page
    FROM (SELECT *, row_number() OVER (ORDER BY elapsed_ms DESC NULLS LAST, created_at DESC, id DESC) AS position, CAST(least(2,
    greatest(ceil(count(*) OVER () / 20), 1)) AS INT) AS page
    FROM h WHERE contains(id, '1')) WHERE position > (page - 1) * 20 AND position <= page * 20""", "runs")
def i5_run_history(t: Tables) -> DataFrame:
    rows = t["runs"].withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("created_at") * 60))
    rows = rows.withColumn("started_at", F.col("created_at")).withColumn("index_id", F.lit("i")).withColumn("index_name",
        F.lit("i")).withColumn("dataset_id", F.lit("d")).withColumn("dataset_name", F.lit("d"))
    found = history.run_history(rows, "2026-01-01 00:00:00", text=" 1 ", sort="longest", page=2)
    return found.select("id", "status", F.col("elapsed_ms").cast("long").alias("elapsed_ms"),
        F.col("elapsed_seconds").cast("long").alias("elapsed_seconds"), "percent", "position", "page")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('running', 'pending')) AS active,
    count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM runs""", "runs")
def i6_status_counts(t: Tables) -> DataFrame:
    return history.status_counts(t["runs"])


@query("SELECT run_id, id FROM example_runs WHERE status = 'completed' AND contains(lower(question), 'cli')", "example_runs")
def i7_filtered_questions(t: Tables) -> DataFrame:
    return history.filter_examples(t["example_runs"], "completed", "CLI").select("run_id", "id")


@query("SELECT run_id, status, count(*) AS examples FROM example_runs GROUP BY ALL", "example_runs")
def i7_question_status_counts(t: Tables) -> DataFrame:
    return history.example_status_counts(t["example_runs"])


@query("""SELECT kind, id, created_at FROM (SELECT created_at, 'run' AS kind, id, status
    FROM runs UNION ALL SELECT ordinal, 'preparation', id, status
    FROM example_runs UNION ALL SELECT created_at, 'evaluation', id, status
    FROM runs) WHERE status = 'pending'""", "runs", "example_runs")
def i8_pending_backlog(t: Tables) -> DataFrame:
    return history.pending_backlog(t["example_runs"].withColumnRenamed("ordinal", "created_at"), t["runs"], t["runs"]).select("kind", "id", "created_at")


@query("""SELECT s_suppkey AS id, p.n AS chunk_count, CAST(c.n AS BIGINT) AS vector_count, CASE WHEN s_suppkey % 3 > 0 THEN 'completed'
    ELSE 'running' END AS chunking_status, CASE WHEN s_suppkey % 5 > 0 THEN 'completed' ELSE 'pending' END AS embedding_status
    FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem
    GROUP BY ALL) p ON l_suppkey = s_suppkey AND s_suppkey % 3 > 0
    LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c ON c_nationkey = s_nationkey AND s_suppkey % 5 > 0""")
def i9_prepared_indexes(t: Tables) -> DataFrame:
    prepared = t["supplier"].select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey")).alias("chunk_set_id"),
        F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey")).alias("vector_index_id"), F.lit("running").alias("status"), F.lit("chunking").alias("stage"))
    chunk_sets = t["lineitem"].groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("chunk_count"))
    indexes = t["customer"].groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("vector_count"))
    return history.prepared_index_list(prepared, chunk_sets, indexes).select("id", "chunk_count", "vector_count", "chunking_status", "embedding_status")


@query("""SELECT n_nationkey AS corpus_id, n_name AS name, count(c_custkey) AS documents, count(c_custkey) FILTER (WHERE c_acctbal > 0) AS parsed,
    CAST(sum(length(c_name)) FILTER (WHERE c_acctbal > 0) AS BIGINT) AS characters
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def i10_corpus_inventory(t: Tables) -> DataFrame:
    corpora = t["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at"))
    docs = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("corpus_id"))
    parses = t["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.length("c_name").cast("long").alias("character_count"))
    return history.corpus_inventory(corpora, docs, parses).select("corpus_id", "name", "documents", "parsed", "characters")


# --- audits ------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def j1_orphans(t: Tables) -> DataFrame:
    return audit.orphans(t["lineitem"], t["part"].where("p_size > 5"), {"l_partkey": "p_partkey"}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def j2_duplicate_keys(t: Tables) -> DataFrame:
    return audit.duplicate_keys(t["lineitem"], ["l_orderkey", "l_linenumber"])


_RULES = {"quantity": "l_quantity <= 45", "discount": "l_discount between 0 and 0.08", "flag": "l_returnflag in ('A', 'N')"}


@query("""SELECT l_orderkey, l_linenumber, rule FROM (SELECT l_orderkey, l_linenumber, unnest([CASE WHEN NOT l_quantity <= 45 THEN 'quantity' END,
    CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'discount' END, CASE WHEN NOT l_returnflag IN ('A', 'N') THEN 'flag' END]) AS rule
    FROM lineitem) WHERE rule IS NOT NULL""")
def j3_rule_violations(t: Tables) -> DataFrame:
    return audit.rule_violations(t["lineitem"], _RULES, ["l_orderkey", "l_linenumber"])
