"""Queries over files, retrieval, and the parts of operators that the other modules don't show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialize, new_folder
from ..operators import audit, canonical, chunking, context, evaluation, history, indexing, merkle, search, segments, tokenizers, vectors
from ..sources import files
from .queries import EMBEDDED, query
from .views import Tables

# --- files -------------------------------------------------------------------------------------------------------


@query("SELECT CAST(33 * count(*) AS BIGINT) AS size_bytes, true AS hashed, 'txt' AS extension FROM documents")
def a1_read_files(t: Tables) -> DataFrame:
    """Text files of hashes, read as documents."""
    folder = new_folder(t.spark, "read-files")
    t["documents"].select(F.md5(F.coalesce("text", F.lit("")))).write.text(folder)
    read = files.read_documents(t.spark, f"{folder}/*.txt", "c")
    return read.groupBy("extension").agg(F.sum("size_bytes").alias("size_bytes"),
        F.bool_and((F.length("content_sha256") == 64) & (F.length("content") == F.col("size_bytes"))).alias("hashed"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN page_id % 2 = 0 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN page_id % 2 = 1 ELSE false END AS content_ok
    FROM pages""")
def a3_content_checks(t: Tables) -> DataFrame:
    """pdf with and without its head, text, an archive that is none, text with and without a zero, an unknown format."""
    k = (F.col("page_id") % 5).cast("int")
    ext = F.element_at(F.array(*map(F.lit, ("pdf", "md", "docx", "txt", "exe"))), k + 1)
    even = F.col("page_id") % 2 == 0
    head = F.when(k == 0, F.when(even, "%PDF-1.7").otherwise("PDF")).when(k == 2, "PK").when(k == 3, F.when(even, "\0").otherwise("a")).otherwise("b")
    rows = t["pages"].select("page_id", ext.alias("ext"), F.encode(F.concat(head, F.coalesce("html", F.lit(""))), "UTF-8").alias("content"))
    return rows.select("page_id", files.content_matches_format(F.col("content"), F.col("ext")).alias("content_ok"))


_SETS = ("{broken", '{"examples":[]}', '{"examples":[{"question":1}]}', '{"examples":[{"question":"q","relevant_documents":null}]}',
    '{"examples":[{"question":"q","x":1}]}')


@query("""SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 6 = 5 THEN unnest([0, 1]) END AS ordinal, CASE WHEN doc_id % 6 = 5 THEN md5('q'
    || doc_id) END AS question, CASE doc_id % 6 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'no_examples' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'wrong_type'
    WHEN 4 THEN 'unknown_field' END AS error
    FROM documents WHERE doc_id % 6 = 5 UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, CASE doc_id % 6 WHEN 0 THEN 'bad_json'
    WHEN 1 THEN 'no_examples' WHEN 2 THEN 'wrong_type' WHEN 3 THEN 'wrong_type' WHEN 4 THEN 'unknown_field' END
    FROM documents WHERE doc_id % 6 < 5""")
def a6_question_sets(t: Tables) -> DataFrame:
    asked = F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question")
    good = F.to_json(F.struct(F.array(F.struct(asked, F.array(F.lit("a")).alias("relevant_documents"),
        F.lit(None).cast("string").alias("reference_answer")), F.struct(asked, F.array().cast("array<string>").alias("relevant_documents"),
        F.lit("r").alias("reference_answer"))).alias("examples")), {"ignoreNullFields": "false"})
    k = (F.col("doc_id") % 6).cast("int")
    text = F.when(k == 5, good).otherwise(F.get(F.array(*map(F.lit, _SETS)), k))
    raw = t["documents"].select(F.col("doc_id").cast("string").alias("file"), F.length(text).alias("length"), text.alias("text"))
    return files.parse_question_sets(raw).select("file", "ordinal", F.md5("question").alias("question"), "error")


@query("SELECT id, lang, 'a1' AS artifact_id, false AS again FROM docs", "docs")
def a7_artifact(t: Tables) -> DataFrame:
    """An artifact that is asked for twice and written once."""
    folder, rows = new_folder(t.spark, "artifacts"), t["docs"].select("id", "lang")
    files.write_artifact(rows, folder, "a1", {"fingerprint": "f"})
    again = files.write_artifact(rows, folder, "a2", {"fingerprint": "f"})
    return files.read_artifacts(t.spark, folder).select("id", "lang", "artifact_id", F.lit(again).alias("again"))


@query("SELECT id, status, total_examples FROM runs", "runs")
def a8_exported_runs(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "export")
    files.export_runs(t["runs"].select("id", "status", "total_examples"), folder)
    return t.spark.read.schema("id string, status string, total_examples long").json(folder)


# --- parses ------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty_parsed_document' WHEN doc_id % 5 IN (1, 2, 3) THEN 'invalid_parser_output' END AS reject_code
    FROM documents""")
def b7_metadata_checks(t: Tables) -> DataFrame:
    """Metadata, warnings, and boxes of parts; texts come first, and names in strings don't matter."""
    k, n = (F.col("doc_id") % 5).cast("int"), F.col("doc_id")
    metadata = F.get(F.array(*map(F.lit, ('{"title":"To Infinity and NaN"}', '{"a":NaN}', "{}", "{}", "{}"))), k)
    warnings = F.when(k == 2, "[1,").otherwise('["w"]')
    parses = t["documents"].select("doc_id", F.col("doc_id").alias("document_id"), F.when(n % 11 == 0, " ").otherwise("x").alias("text"),
        F.lit("p").alias("parser_name"), F.lit("1").alias("parser_version"), metadata.alias("metadata"), warnings.alias("warnings"))
    blocks = t["documents"].select(F.col("doc_id").alias("document_id"), F.lit("{}").alias("metadata"),
        F.when(k == 3, "[0,").when(k == 4, "[0,1]").alias("bounding_box"))
    return canonical.validate_parses(parses, canonical.broken_json(blocks)).select("doc_id", "reject_code")


# --- retrieval ---------------------------------------------------------------------------------------------------
# Every document is embedded, and every document whose id is divisible by 100 asks for its own kind; others of them are blank.

_INDEX = {"status": "ready", "provider": "local", "model": "hashing", "distance_metric": "cosine", "input_policy_version": "1",
    "indexer_name": "exact", "indexer_version": "1", "collection_name": "c", "dimensions": 64, "chunk_set_id": "s"}


def _retrieved(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs, embedder = t["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vectors.hashing_embedder()
    own = materialize(vectors.embed(docs, embedder).select(F.col("doc_id").cast("string").alias("chunk_id"), "embedding"))
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 3,
        "other").otherwise("s").alias("chunk_set_id"), F.md5("text").alias("text"))
    question = F.when(F.col("doc_id") % 300 == 0, " \n").otherwise(F.col("text"))
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), question.alias("question"))
    return search.retrieve(asked, _INDEX | {"vector_count": own.count()}, own, chunks, 5, embedder, _INDEX)


_RETRIEVED = "WITH " + EMBEDDED + """, asked AS (SELECT doc_id, embedding FROM embedded WHERE doc_id % 100 = 0 AND doc_id % 300 <> 0),
near AS (SELECT q.doc_id AS q, v.doc_id AS c, coalesce(round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])),
    12), 1) AS d FROM asked q CROSS JOIN embedded v),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN isnan(d) THEN 1 ELSE d END, CAST(c AS VARCHAR)) AS INT) AS rank FROM near QUALIFY rank <= 5)
"""


@query(_RETRIEVED + """SELECT CAST(q AS VARCHAR) AS query_id, rank, CAST(c AS VARCHAR) AS chunk_id, md5(coalesce(text, '')) AS text
    FROM top JOIN documents ON doc_id = c WHERE q NOT IN (SELECT q FROM top WHERE c % 7 = 3)""")
def e6_retrieved_evidence(t: Tables) -> DataFrame:
    return _retrieved(t)[0].select("query_id", "rank", "chunk_id", "text")


@query(_RETRIEVED + """SELECT DISTINCT CAST(q AS VARCHAR) AS query_id, 'missing_or_foreign_chunk' AS error
    FROM top WHERE c % 7 = 3 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'blank_question'
    FROM documents WHERE doc_id % 300 = 0""")
def e6_retrieval_errors(t: Tables) -> DataFrame:
    return _retrieved(t)[1]


@query("SELECT CAST(label AS VARCHAR) AS index_id, CAST(vec_id AS VARCHAR) AS chunk_id FROM embeddings WHERE label = 3 AND vec_id % 2 = 1")
def d4_missing_vectors(t: Tables) -> DataFrame:
    rows = t["embeddings"].select(F.col("label").cast("string").alias("index_id"), F.col("vec_id").cast("string").alias("chunk_id"), "label", "vec_id")
    return vectors.missing_vectors(rows.select("index_id", "chunk_id"), rows.where("label <> 3 or vec_id % 2 = 0"))


# --- evaluations and runs ----------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS evaluation_id, '[' || string_agg('{"ordinal":' || l_linenumber || ',"example_id":' || l_partkey || ',"evidence":"'
    || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) || ']' AS questions
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def h10_evaluation_detail(t: Tables) -> DataFrame:
    asked = t["lineitem"].select(F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("ordinal"),
        F.col("l_partkey").alias("example_id"), F.col("l_returnflag").alias("evidence"))
    found = evaluation.evaluation_detail(t["orders"].select(F.col("o_orderkey").alias("evaluation_id")), asked)
    return found.select("evaluation_id", F.to_json("questions").alias("questions"))


@query("""SELECT o_orderkey AS index_id, o_custkey AS dataset_id, coalesce(reason, '') = '' AS launchable, reason
    FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 OR c_custkey IS NULL THEN 'unknown_input'
    WHEN o_orderstatus = 'O' THEN 'index_not_ready' WHEN o_orderkey % 5 <> c_nationkey % 5 THEN 'different_corpora' END AS reason
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0)""")
def i1_launch_checks(t: Tables) -> DataFrame:
    asked = t["orders"].select(F.col("o_orderkey").alias("index_id"), F.col("o_custkey").alias("dataset_id"))
    indexes = t["orders"].where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("corpus_id"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("ready").alias("status"), F.lit("v").alias("vector_index_id"))
    datasets = t["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("long").alias("corpus_id"))
    return history.launch_checks(asked, indexes, datasets)


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def i2_runs_without_examples(t: Tables) -> DataFrame:
    runs = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("dataset_id"))
    return history.runs_without_examples(runs, t["supplier"].where("s_acctbal > 5000").select(F.col("s_nationkey").alias("dataset_id"))).select("id")


@query("""SELECT r.id, n_name AS index_name, r_name AS dataset_name, e.k AS latest_evaluation_id, e.s AS latest_evaluation_status
    FROM runs r LEFT JOIN nation ON n_nationkey = created_at % 30
    LEFT JOIN region ON r_regionkey = created_at % 5 LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS run_id, arg_max(o_orderkey,
    struct_pack(a := o_orderdate, b := o_orderkey)) AS k, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS s
    FROM orders GROUP BY 1) e ON e.run_id = r.id""", "runs")
def i3_run_names(t: Tables) -> DataFrame:
    runs = t["runs"].select("id", "created_at", (F.col("created_at") % 30).alias("index_id"), (F.col("created_at") % 5).alias("dataset_id"))
    named = lambda name, key, text: t[name].select(F.col(key).cast("long").alias("id"), F.col(text).alias("name"))
    tried = t["orders"].select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"))
    examples = t["example_runs"].select("*", *(F.col("tokens").alias(c) for c in history.USAGE))
    found = history.run_summary(runs, examples, named("nation", "n_nationkey", "n_name"), named("region", "r_regionkey", "r_name"), tried)
    return found.select("id", "index_name", "dataset_name", "latest_evaluation_id", "latest_evaluation_status")


@query("""SELECT n_nationkey AS corpus_id, '[' || coalesce(string_agg('{"uploaded_at":' || c_custkey || ',"id":' || c_custkey
    || ',"original_filename":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"character_count":' || length(c_name) ELSE '' END || '}',
    ',' ORDER BY c_custkey), '') || ']' AS documents
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def i10_corpus_documents(t: Tables) -> DataFrame:
    corpora = t["nation"].select(F.col("n_nationkey").alias("id"))
    docs = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("corpus_id"),
        F.col("c_name").alias("original_filename"), F.col("c_custkey").alias("uploaded_at"))
    parses = t["customer"].where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"), F.length("c_name").alias("character_count"))
    return history.corpus_documents(corpora, docs, parses).select("corpus_id", F.to_json("documents").alias("documents"))


# --- audits ------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id AS n, length(text) AS c FROM documents WHERE text IS NOT NULL) SELECT * FROM (
    SELECT 'document_parse' AS "table", 'normalized_text_not_blank' AS rule, count(*) FILTER (WHERE n % 3 = 0) AS broken FROM d
    UNION ALL SELECT 'document_parse', 'character_count_from_1', count(*) FILTER (WHERE n % 4 = 0) FROM d
    UNION ALL SELECT 'document_parse', 'utf8_size_bytes_from_1', count(*) FILTER (WHERE n % 4 = 0) FROM d
    UNION ALL SELECT 'document_parse', 'duration_ms_from_0', count(*) FILTER (WHERE n % 10 = 7) FROM d
    UNION ALL SELECT 'document_parse', 'warnings_json_json', count(*) FILTER (WHERE n % 5 = 0) FROM d
    UNION ALL SELECT 'document_parse', 'unique document_id', count(*) FROM (SELECT n // 2 AS k FROM d GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'document_parse', 'unique id', 0
    UNION ALL SELECT 'document_parse', 'document_id in document', count(*) FROM d WHERE n // 2 NOT IN (SELECT n FROM d WHERE n % 2 = 1)
    UNION ALL SELECT 'document', 'unique id', 0)""")
def j_declared_audit(t: Tables) -> DataFrame:
    """The declared checks, keys and references of two tables that are made to break them."""
    n = F.col("doc_id")
    docs = t["documents"].where("text is not null")
    some = F.when(n % 4 == 0, 0).otherwise(5)
    parses = docs.select(n.alias("id"), F.floor(n / 2).alias("document_id"), F.when(n % 3 == 0, "  ").otherwise("x").alias("normalized_text"),
        some.alias("character_count"), some.alias("utf8_size_bytes"), (F.when(n % 10 == 7, -1).otherwise(0)).alias("duration_ms"),
        F.when(n % 5 == 0, "{}").otherwise("[]").alias("warnings_json"))
    return audit.audit_model({"document": docs.where("doc_id % 2 = 1").select(n.alias("id")), "document_parse": parses})


# --- index build -------------------------------------------------------------------------------------------------


@query("WITH " + EMBEDDED + """, d AS (SELECT doc_id, source FROM documents)
    SELECT CAST(e.doc_id AS VARCHAR) AS chunk_id, embedding, '{' || coalesce('"corpus_id":"' || source || '",', '')
    || '"document_id":"' || e.doc_id || '"}' AS metadata, 64 AS dimensions, (SELECT count(*) FROM documents) AS vector_count, true AS again
    FROM embedded e JOIN d ON d.doc_id = e.doc_id""")
def d_index_build(t: Tables) -> DataFrame:
    """Every document as a chunk, indexed; asked for again, the index is there."""
    folder = new_folder(t.spark, "indexes")
    meta = vectors.vector_metadata(required={"corpus_id": F.col("source"), "document_id": F.col("doc_id")}, optional={})
    chunks = t["documents"].select(F.col("doc_id").alias("chunk_id"), "text", "doc_id", "source")
    build = lambda: indexing.build_vector_index(chunks, {"id": "s", "fingerprint": "f"}, vectors.hashing_embedder(), folder, metadata=meta)
    row, _ = build()
    _, again = build()
    return indexing.read_vectors(t.spark, row["collection_name"]).select("chunk_id", "embedding", "metadata",
        F.lit(int(row["dimensions"])).alias("dimensions"), F.lit(int(row["vector_count"])).cast("long").alias("vector_count"), F.lit(again).alias("again"))


# --- subword tokenizers ------------------------------------------------------------------------------------------


def _tokenizer(name: str) -> tokenizers.FileTokenizer:
    import public_tokenizers

    return tokenizers.FileTokenizer(public_tokenizers.path(name), pattern=public_tokenizers.PATTERN)


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "ordinal", "start", "end", "token_start", "token_end", F.md5("text").alias("text"))


@query()
def c1_subword_tokens(t: Tables) -> DataFrame:
    """Number of tokens of each document and sums of their offsets, in three tokenizers."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    found = None
    for name in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"):
        rows = chunking.token_offsets(t["documents"].select("doc_id", "text"), tokenizer=_tokenizer(name))
        rows = rows.select("doc_id", F.lit(name).alias("tokenizer"), F.size("token_starts").cast("long").alias("tokens"), total("token_starts").alias("starts"),
            total("token_ends").alias("ends"))
        found = rows if found is None else found.union(rows)
    return found


@query()
def c2_subword_chunks(t: Tables) -> DataFrame:
    return _chunk_rows(chunking.chunk_fixed(t["documents"], 200, 20, _tokenizer("piece_bpe_32k.model"), "doc_id"))


@query()
def c4_subword_chunks(t: Tables) -> DataFrame:
    return _chunk_rows(chunking.chunk_recursive(t["documents"], 200, 20, _tokenizer("byte_bpe_50k.json"), "doc_id"))


@query()
def f2_subword_budget(t: Tables) -> DataFrame:
    """Turns packed under a budget of subword tokens."""
    turns = t["conversations"].select(F.col("conv_id").cast("string").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text")
    asked = turns.select("query_id").distinct().select("query_id", F.lit(10).alias("fixed_tokens"), F.lit(400).alias("context_window_tokens"),
        F.lit(50).alias("max_output_tokens"))
    return context.pack_context(tokenizers.count_tokens(turns, _tokenizer("byte_bpe_50k.json")), asked)


# --- trees of hashes ---------------------------------------------------------------------------------------------

_TREE = """leaves AS (SELECT corpus_id, id, substr(sha256(id), 1, 4) AS place, sha256('{"document_id":"' || id || '","parse_id":"' || parse_id
    || '","uploaded_at":' || uploaded_at || '}') AS h FROM docs),
n4 AS (SELECT corpus_id, place, sha256(string_agg(h, ',' ORDER BY id)) AS h FROM leaves GROUP BY ALL),
n3 AS (SELECT corpus_id, substr(place, 1, 3) AS p, sha256(string_agg(h, ',' ORDER BY place)) AS h FROM n4 GROUP BY ALL),
n2 AS (SELECT corpus_id, substr(p, 1, 2) AS q, sha256(string_agg(h, ',' ORDER BY p)) AS h FROM n3 GROUP BY ALL),
n1 AS (SELECT corpus_id, substr(q, 1, 1) AS r, sha256(string_agg(h, ',' ORDER BY q)) AS h FROM n2 GROUP BY ALL),
n0 AS (SELECT corpus_id, sha256(string_agg(h, ',' ORDER BY r)) AS h FROM n1 GROUP BY ALL)"""


@query("WITH " + _TREE + """ SELECT corpus_id, sha256('{"cap":32000,"chunker":"fixed","chunker_version":"1","config":"200/20","corpus_id":"' || corpus_id
    || '","root":"' || h || '","tokenizer":"whitespace"}') AS fingerprint FROM n0""", "docs")
def c10_tree_fingerprints(t: Tables) -> DataFrame:
    """The tree over all documents but those of every seventh id, to which these are then added."""
    docs = t["docs"]
    own = materialize(merkle.leaves(docs, docs.select(F.col("id").alias("document_id"), "parse_id")))
    late = F.col("document_id").cast("long") % 7 == 0
    before = materialize(merkle.tree(own.where(~late)))
    nodes = merkle.grown(before, materialize(merkle.rehashed(before, own.where(~late), own.where(late))))
    return merkle.set_fingerprints(nodes, "200/20", "fixed", "whitespace", "1")


# --- long lists --------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT c_nationkey AS corpus_id, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer)
    SELECT corpus_id, place // 7 AS segment, CAST(count(*) AS INT) AS n, CAST(min(c_custkey) AS BIGINT) AS first, CAST(max(c_custkey) AS BIGINT) AS last,
    '[' || string_agg('{"uploaded_at":' || c_custkey || ',"id":' || c_custkey || ',"original_filename":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0
    THEN ',"character_count":' || length(c_name) ELSE '' END || '}', ',' ORDER BY c_custkey) || ']' AS documents
    FROM d GROUP BY corpus_id, place // 7""")
def i10_document_segments(t: Tables) -> DataFrame:
    docs = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("corpus_id"),
        F.col("c_name").alias("original_filename"), F.col("c_custkey").alias("uploaded_at"))
    parses = t["customer"].where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("document_id"), F.length("c_name").alias("character_count"))
    found = segments.document_segments(docs, parses, size=7)
    return found.select("corpus_id", "segment", "n", F.col("first.id").cast("long").alias("first"), F.col("last.id").cast("long").alias("last"),
        F.to_json("items").alias("documents"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || l_returnflag) - 1 AS place FROM lineitem)
    SELECT l_orderkey AS evaluation_id, place // 3 AS segment, CAST(count(*) AS INT) AS n, string_agg(l_linenumber || l_returnflag, ',' ORDER BY place) AS questions
    FROM d GROUP BY l_orderkey, place // 3""")
def h10_evaluation_segments(t: Tables) -> DataFrame:
    asked = t["lineitem"].select(F.col("l_orderkey").alias("evaluation_id"), F.col("l_linenumber").alias("ordinal"),
        F.concat("l_partkey", "l_returnflag").alias("example_id"), F.col("l_returnflag").alias("evidence"))
    found = segments.evaluation_segments(asked, size=3)
    return found.select("evaluation_id", "segment", "n", F.array_join(F.transform("items", lambda x: F.concat(x["ordinal"].cast("string"), x["evidence"])), ",").alias("questions"))
