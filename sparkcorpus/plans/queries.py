"""Queries over the test tables, one for each operator of the library, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize
from ..functions.text import uuid5
from ..operators import canonical, cells, chunking, chunksets, evaluation, search, vectors
from ..sources import files
from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = r"[\x20\x09-\x0D]+"


def query(sql: str | None = None, *views: str):
    """Register a function of the tables under its name."""

    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[run.__name__] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
        if sql is not None:
            SQL[run.__name__] = with_views(sql, *views) if views else sql
        return run

    return register


# --- search and scores -------------------------------------------------------------------------------------------

_HITS = """
all_pairs AS (SELECT q.query_id, v.chunk_id, v.label, {distance} AS d FROM questions q CROSS JOIN vectors v),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INT) AS rank FROM all_pairs QUALIFY rank <= 10)
"""
_COSINE = "1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_DOT = "1 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"
_EUCLID = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) ** 2"


def _hits(t: Tables, metric: str = "cosine", k: int = 10) -> DataFrame:
    return search.top_k(t["questions"].select("query_id", "embedding"), t["vectors"].select("chunk_id", "embedding"), k, metric)


def _document_hits(t: Tables) -> DataFrame:
    return _hits(t).join(t["vectors"].select("chunk_id", F.col("label").alias("document_id")), "chunk_id").withColumnRenamed("query_id", "example_id")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("raw_distance", F.round("raw_distance", 6) + 0.0)


def _scores(t: Tables) -> DataFrame:
    return evaluation.score_retrieval(t["questions"].select(F.col("query_id").alias("example_id")), t["labels_"], _document_hits(t), 10)


_SCORES = "WITH" + _HITS.format(distance=_COSINE) + """,
lab AS (SELECT example_id, count(DISTINCT document_id) AS labels FROM labels_ GROUP BY example_id),
hit AS (SELECT h.query_id, min(h.rank) AS first, count(DISTINCT h.label) AS found FROM hits h JOIN labels_ l ON l.example_id = h.query_id
    AND l.document_id = h.label GROUP BY h.query_id),
scores AS (SELECT q.query_id AS example_id, CASE WHEN labels IS NOT NULL THEN CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END END AS hit_rate,
                  CASE WHEN labels IS NOT NULL THEN coalesce(found / labels, 0.0) END AS recall, CASE WHEN labels IS NOT NULL THEN coalesce(1.0 / first, 0.0) END AS mrr,
                  CASE WHEN labels IS NULL THEN 'no_resolved_document_labels' END AS skipped_reason
           FROM questions q LEFT JOIN lab ON lab.example_id = q.query_id LEFT JOIN hit ON hit.query_id = q.query_id)
"""


@query(_SCORES + """SELECT metric, round(avg(score), 6) AS mean_score, count(*) AS total, count(score) AS eligible, count(score) AS scored,
    count(*) - count(score) AS skipped, CAST(0 AS BIGINT) AS errors
    FROM (SELECT 'hit_rate' AS metric, hit_rate AS score FROM scores
    UNION ALL SELECT 'recall', recall FROM scores UNION ALL SELECT 'mrr', mrr
    FROM scores) GROUP BY metric""", "vectors", "questions", "labels_")
def h3_retrieval_summary(t: Tables) -> DataFrame:
    return evaluation.aggregate_retrieval(_scores(t)).withColumn("mean_score", F.round("mean_score", 6))


@query(_SCORES + "SELECT example_id, hit_rate, round(recall, 6) AS recall, round(mrr, 6) AS mrr, skipped_reason FROM scores", "vectors", "questions", "labels_")
def h1_question_scores(t: Tables) -> DataFrame:
    return _scores(t).withColumn("recall", F.round("recall", 6)).withColumn("mrr", F.round("mrr", 6))


@query("WITH" + _HITS.format(distance=_COSINE) + """, m AS (SELECT h.*, l.document_id FROM hits h LEFT JOIN (SELECT DISTINCT *
    FROM labels_) l ON l.example_id = h.query_id AND l.document_id = h.label)
    SELECT q.query_id AS example_id, coalesce(list(rank ORDER BY rank) FILTER (WHERE m.document_id IS NOT NULL), []) AS matching_ranks, list(m.label
    ORDER BY rank) AS ranked_documents, coalesce((SELECT list(DISTINCT l.document_id
    ORDER BY l.document_id) FROM labels_ l WHERE l.example_id = q.query_id), []) AS labels
    FROM questions q JOIN m ON m.query_id = q.query_id GROUP BY q.query_id""", "vectors", "questions", "labels_")
def h2_ranking_evidence(t: Tables) -> DataFrame:
    return evaluation.retrieval_evidence(t["questions"].select(F.col("query_id").alias("example_id")), t["labels_"], _document_hits(t), 10)


def _top_k_sql(distance: str) -> str:
    return "WITH" + _HITS.format(distance=distance) + "SELECT query_id, rank, chunk_id, round(d, 6) + 0.0 AS raw_distance FROM hits"


@query(_top_k_sql(_COSINE), "vectors", "questions")
def e2_top_k_cosine(t: Tables) -> DataFrame:
    return _rounded(_hits(t))


@query(_top_k_sql(_DOT), "vectors", "questions")
def e2_top_k_dot_product(t: Tables) -> DataFrame:
    return _rounded(_hits(t, "dot_product"))


@query(_top_k_sql(_EUCLID), "vectors", "questions")
def e2_top_k_euclidean(t: Tables) -> DataFrame:
    return _rounded(_hits(t, "euclidean"))


@query(f"""WITH all_pairs AS (SELECT q.chunk_id AS query_id, v.chunk_id, {_COSINE} AS d FROM vectors q CROSS JOIN vectors v)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS INT) AS rank, chunk_id, round(d, 6) + 0.0 AS raw_distance
    FROM all_pairs QUALIFY rank <= 10""", "vectors")
def e2_every_vector(t: Tables) -> DataFrame:
    """Every vector as a question, with the vectors in cells."""
    made = cells.cells(t["vectors"].select("chunk_id", "embedding"))
    return _rounded(cells.top_k_in_cells(t["vectors"].select(F.col("chunk_id").alias("query_id"), "embedding"), made))


@query(f"""SELECT v.chunk_id, round({_COSINE}, 6) + 0.0 AS cosine, round({_DOT}, 6) + 0.0 AS dot_product, round({_EUCLID}, 6) + 0.0 AS euclidean
    FROM vectors v JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding
    FROM vectors GROUP BY label) q ON q.label = v.label""", "vectors")
def e1_distances(t: Tables) -> DataFrame:
    first = t["vectors"].groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    rows = t["vectors"].join(first, "label")
    return rows.select("chunk_id", *((F.round(search.distance(F.col("q"), F.col("embedding"), m), 6) + 0.0).alias(m) for m in search.METRICS))


@query("WITH" + _HITS.format(distance=_COSINE) + """SELECT query_id, count(*) AS hits, count(*) = 10 AND count(DISTINCT chunk_id) = count(*) AS valid
    FROM hits GROUP BY query_id""", "vectors", "questions")
def e3_hit_checks(t: Tables) -> DataFrame:
    return search.validate_hits(_hits(t), F.lit(10))


def _vector_chunks(t: Tables) -> DataFrame:
    return t["vectors"].select(F.col("chunk_id").alias("id"), F.when(F.col("label") < 8, "set-a").otherwise("set-b").alias("chunk_set_id"),
        F.col("label").alias("document_id"))


@query("WITH" + _HITS.format(distance=_COSINE) + """, m AS (SELECT *, CAST(chunk_id AS BIGINT) % 25 = 3 AS other,
    bool_or(CAST(chunk_id AS BIGINT) % 25 = 3) OVER (PARTITION BY query_id) AS broken FROM hits)
    SELECT query_id, rank, chunk_id, CASE WHEN NOT other THEN label END AS document_id, CASE WHEN other THEN 'missing_or_foreign_chunk' END AS error
    FROM m WHERE other OR NOT broken""", "vectors", "questions")
def e4_hydrated_hits(t: Tables) -> DataFrame:
    """All hits of a question, or those that are wrong."""
    chunks = t["vectors"].select(F.col("chunk_id").alias("id"), F.when(F.col("vec_id") % 25 == 3, "set-b").otherwise("set-a").alias("chunk_set_id"),
        F.col("label").alias("document_id"))
    good, bad = search.hydrate(_hits(t), chunks, "set-a")
    return good.select("query_id", "rank", "chunk_id", "document_id", F.lit(None).cast("string").alias("error")).unionByName(bad, allowMissingColumns=True)


@query("WITH" + _HITS.format(distance=_COSINE) + "SELECT query_id, count(*) = count(*) FILTER (WHERE label < 8) AS valid FROM hits GROUP BY query_id", "vectors", "questions")
def e5_ranking_integrity(t: Tables) -> DataFrame:
    results = t["questions"].select("query_id", F.lit(10).alias("requested_top_k"), F.lit("set-a").alias("chunk_set_id"),
        F.lit("cosine").alias("distance_metric"), F.lit("cosine").alias("run_metric"))
    return search.validate_rankings(results, _hits(t), _vector_chunks(t))


# --- canonical text ----------------------------------------------------------------------------------------------

_TEXTS = """
blocks AS (SELECT document_id, page_number, CAST(unnest(range(len(x))) AS INT) AS block_index, regexp_replace(unnest(x), '^\\s+|\\s+$', '',
    'g') AS text FROM (SELECT document_id, page_number, string_split(text, chr(10)) AS x FROM pages_)),
kept AS (SELECT * FROM blocks WHERE text <> ''),
texts AS (SELECT p.document_id, p.page_number, coalesce(k.joined, p.text) AS text, k.joined IS NOT NULL AS has_blocks FROM pages_ p
          LEFT JOIN (SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY block_index) AS joined FROM kept GROUP BY ALL) k
    ON k.document_id = p.document_id AND k.page_number = p.page_number),
offs AS (SELECT document_id, page_number, e - length(text) AS start, e AS "end" FROM (SELECT *,
    sum(length(text)) OVER w + 2 * greatest(sum(CAST(length(text) > 0 AS INT)) OVER w - 1, 0) AS e
    FROM texts WINDOW w AS (PARTITION BY document_id ORDER BY page_number))),
whole AS (SELECT document_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (WHERE length(text) > 0), '') AS text
    FROM texts GROUP BY document_id),
blk AS (SELECT k.document_id, k.page_number, k.block_index, row_number() OVER (PARTITION BY k.document_id ORDER BY k.page_number,
    k.block_index) - 1 AS ordinal, length(k.text) AS n, k.text,
               sum(length(k.text)) OVER w + 2 * (count(*) OVER w - 1) AS e FROM kept k WINDOW w AS (PARTITION BY k.document_id, k.page_number ORDER BY k.block_index)),
boffs AS (SELECT b.document_id, b.page_number, block_index, CAST(ordinal AS INT) AS ordinal, CAST(o.start + e - n AS BIGINT) AS start,
    CAST(o.start + e AS BIGINT) AS "end", text FROM blk b JOIN offs o ON o.document_id = b.document_id AND o.page_number = b.page_number)
"""


def _texts(t: Tables) -> DataFrame:
    return canonical.page_text(t["pages_"], t.blocks())


def _canonical(t: Tables) -> DataFrame:
    return canonical.canonical_text(_texts(t))


@query("WITH" + _TEXTS + "SELECT document_id, page_number, md5(text) AS text, has_blocks FROM texts", "pages_")
def b3_page_text(t: Tables) -> DataFrame:
    return _texts(t).withColumn("text", F.md5("text"))


@query("WITH" + _TEXTS + "SELECT document_id, md5(text) AS text, length(text) AS characters FROM whole", "pages_")
def b4_canonical_text(t: Tables) -> DataFrame:
    return _canonical(t).select("document_id", F.md5("text").alias("text"), F.length("text").cast("long").alias("characters"))


@query("WITH" + _TEXTS + 'SELECT document_id, page_number, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM offs', "pages_")
def b5_page_offsets(t: Tables) -> DataFrame:
    return canonical.page_offsets(_texts(t))


@query("WITH" + _TEXTS + 'SELECT document_id, page_number, block_index, ordinal, start, "end", md5(text) AS text FROM boffs', "pages_")
def b6_block_offsets(t: Tables) -> DataFrame:
    return canonical.block_offsets(_texts(t), t.blocks()).withColumn("text", F.md5("text"))


@query("WITH" + _TEXTS + 'SELECT document_id, page_number, ordinal, md5(text) AS body FROM boffs', "pages_")
def b11_sliced_blocks(t: Tables) -> DataFrame:
    ranges = canonical.block_offsets(_texts(t), t.blocks()).drop("text")
    return canonical.slice_text(_canonical(t), ranges).select("document_id", "page_number", "ordinal", F.md5("body").alias("body"))


@query("""SELECT document_id, page_number, i AS source_index, text, row_number() OVER (PARTITION BY document_id, page_number
    ORDER BY y0, x0, i) - 1 AS reading_order FROM (SELECT *, CAST(length(text) % 3 AS DOUBLE) AS y0, CAST(i % 2 AS DOUBLE) AS x0
    FROM (SELECT document_id, page_number, CAST(unnest(range(len(x))) AS INT) AS i, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS text
    FROM (SELECT document_id, page_number, string_split(text, chr(10)) AS x
    FROM pages_))) WHERE text <> ''""", "pages_")
def b1_reading_order(t: Tables) -> DataFrame:
    stripped = canonical.strip(F.col("text"))
    blocks = t.blocks().withColumn("text", stripped).withColumn("y0", (F.length("text") % 3).cast("double")).withColumn("x0",
        (F.col("block_index") % 2).cast("double")).withColumnRenamed("block_index", "source_index")
    return canonical.reading_order(blocks).select("document_id", "page_number", "source_index", "text",
        F.col("reading_order").cast("long").alias("reading_order"))


@query("""SELECT c_nationkey AS document_id, 0 AS table_index, CAST(c_custkey AS INT) AS row_index, concat_ws(' | ', nullif(trim(c_name), ''),
    nullif(trim(c_mktsegment), '')) AS text
    FROM customer""")
def b2_table_rows(t: Tables) -> DataFrame:
    cells = t["customer"].select(F.col("c_nationkey").alias("document_id"), F.lit(0).alias("table_index"),
        F.col("c_custkey").cast("int").alias("row_index"), F.posexplode(F.array(F.col("c_name"), F.lit("  "),
        F.col("c_mktsegment"))).alias("col_index", "text"))
    return canonical.table_rows_to_blocks(cells)


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid_parser_output' WHEN regexp_full_match(text, '\\s*') THEN 'empty_parsed_document'
    WHEN strlen(text) > 52428800 THEN 'parsed_document_too_large' END AS reject_code
    FROM documents""")
def b7_parse_checks(t: Tables) -> DataFrame:
    parses = t["documents"].select("doc_id", "text", F.when(F.col("doc_id") % 7 == 0, " ").otherwise("reader").alias("parser_name"),
        F.lit("1").alias("parser_version"), F.lit("{}").alias("metadata"))
    return canonical.validate_parses(parses).select("doc_id", "reject_code")


@query("WITH" + _TEXTS + """SELECT w.document_id, strlen(w.text) AS utf8_size_bytes, length(w.text) AS character_count, (SELECT count(*)
    FROM pages_ p WHERE p.document_id = w.document_id) AS page_count, (SELECT count(*)
    FROM kept k WHERE k.document_id = w.document_id) AS block_count
    FROM whole w""", "pages_")
def b8_parse_stats(t: Tables) -> DataFrame:
    return canonical.parse_stats(_canonical(t), t["pages_"], canonical.block_offsets(_texts(t), t.blocks()))


@query("""SELECT document_id, list('Page ' || page_number || ' has no text'
    ORDER BY page_number) AS warnings FROM pages_ WHERE page_number % 3 = 0 OR regexp_full_match(text, '\\s*')
    GROUP BY document_id""", "pages_")
def b9_page_warnings(t: Tables) -> DataFrame:
    return canonical.page_warnings(t["pages_"].withColumn("text", F.when(F.col("page_number") % 3 == 0, " \n").otherwise(F.col("text"))))


_PAGE_JSON = """SELECT w.document_id, md5(w.text) AS text, md5('[' || string_agg('{"page_number":' || o.page_number || ',"start":'
    || CAST(o.start AS BIGINT) || ',"end":' || CAST(o."end" AS BIGINT)
    || ',"blocks":[' || coalesce((SELECT string_agg('{"ordinal":' || ordinal || ',"start":' || start || ',"end":' || "end" || '}', ',' ORDER BY ordinal) FROM boffs b
    WHERE b.document_id = o.document_id AND b.page_number = o.page_number), '') || ']}', ',' ORDER BY o.page_number) || ']') AS pages
    FROM whole w JOIN offs o ON o.document_id = w.document_id GROUP BY w.document_id, w.text"""


@query("WITH" + _TEXTS + _PAGE_JSON, "pages_")
def b10_parse_readback(t: Tables) -> DataFrame:
    texts = _texts(t)
    found = canonical.parsed_documents(_canonical(t), canonical.page_offsets(texts), canonical.block_offsets(texts, t.blocks()))
    return found.select("document_id", F.md5("text").alias("text"), F.md5(F.to_json("pages")).alias("pages"))


# --- tokens and chunks -------------------------------------------------------------------------------------------

_TOKENS = r"""
pieces AS (SELECT document_id, unnest(range(len(x))) AS i, unnest(x) AS piece FROM (SELECT {id} AS document_id, regexp_extract_all(text,
    '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS x FROM {of})),
tok AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS k, e - length(piece) AS s, e, count(*) OVER (PARTITION BY document_id) AS n
        FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS e FROM pieces) WHERE NOT regexp_matches(piece, '^[\x20\x09-\x0D]')),
fixed AS (SELECT a.document_id, CAST(a.k // {stride} AS INT) AS ordinal, CAST(a.s AS BIGINT) AS start, CAST(z.e AS BIGINT) AS "end",
    CAST(a.k AS BIGINT) AS token_start, CAST(least(a.k + {size}, a.n) AS BIGINT) AS token_end
          FROM tok a JOIN tok z ON z.document_id = a.document_id AND z.k = least(a.k + {size}, a.n) - 1 WHERE a.k % {stride} = 0 AND (a.k = 0
    OR a.k - {stride} + {size} < a.n))
"""


@query("WITH" + _TOKENS.format(id="doc_id", of="documents", stride=1, size=1) + """SELECT d.doc_id, count(t.k) AS tokens, CAST(coalesce(sum(t.s),
    0) AS BIGINT) AS starts, CAST(coalesce(sum(t.e), 0) AS BIGINT) AS ends
    FROM documents d LEFT JOIN tok t ON t.document_id = d.doc_id
    GROUP BY d.doc_id""")
def c1_token_offsets(t: Tables) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    rows = chunking.token_offsets(t["documents"].select("doc_id", "text"))
    return rows.select("doc_id", chunking.token_count(F.col("text")).alias("tokens"), total("token_starts").alias("starts"), total("token_ends").alias("ends"))


@query("WITH" + _TOKENS.format(id="doc_id", of="documents", stride=180,
    size=200) + 'SELECT document_id, ordinal, start, "end", token_start, token_end, md5(substr(text, start + 1, "end" - start)) AS text FROM fixed JOIN documents ON doc_id = document_id')
def c2_fixed_chunks(t: Tables) -> DataFrame:
    return chunking.chunk_fixed(t["documents"], 200, 20, id_col="doc_id").withColumn("text", F.md5("text"))


@query()
def c3_paragraph_chunks(t: Tables) -> DataFrame:
    return chunking.chunk_paragraph(_canonical(t), 100)


@query()
def c4_recursive_chunks(t: Tables) -> DataFrame:
    return chunking.chunk_recursive(t["documents"], 200, 20, id_col="doc_id")


@query("""SELECT document_id, ordinal, CAST(part AS INT) AS part, start, start + length(x) AS \"end\", md5(x) AS text
    FROM (SELECT doc_id AS document_id, 0 AS ordinal, part, part * 1000 AS start, substr(text, part * 1000 + 1, 1000) AS x
    FROM (SELECT *, unnest(range(CAST(ceil(length(text) / 1000) AS BIGINT))) AS part
    FROM documents)) WHERE regexp_matches(x, '[^\\s]')""")
def c5_capped_chunks(t: Tables) -> DataFrame:
    chunks = t["documents"].select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"), "text", F.lit(0).cast("long").alias("start"),
        F.length("text").cast("long").alias("end"), F.lit(0).alias("token_start"), F.lit(1).alias("token_end"))
    return chunking.enforce_character_cap(chunks, cap=1000).select("document_id", "ordinal", "part", "start", "end", F.md5("text").alias("text"))


@query("SELECT id, corpus_id FROM docs WHERE lang = 'en'", "docs")
def c6_unparsed_documents(t: Tables) -> DataFrame:
    parses = t["docs"].where("lang <> 'en'").select(F.col("id").alias("document_id"))
    return chunksets.unparsed_documents(t["docs"], parses).select("id", "corpus_id")


@query("""SELECT corpus_id, count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS unparsed, CASE WHEN corpus_id IN ('src1',
    'src2') THEN 'unknown' WHEN count(*) FILTER (WHERE lang = 'en') > 0 THEN 'incomplete' ELSE 'ready' END AS state
    FROM docs GROUP BY corpus_id UNION ALL SELECT 'none', 0, 0, 'empty'""", "docs")
def c6_corpus_readiness(t: Tables) -> DataFrame:
    docs = t["docs"]
    corpora = docs.select(F.col("corpus_id").alias("id")).where("id not in ('src1', 'src2')").union(t.spark.sql("SELECT 'none'")).distinct()
    return chunksets.corpus_readiness(corpora, docs, docs.where("lang <> 'en'").select(F.col("id").alias("document_id")))


def _page_chunks(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = materialize(_texts(t))  # read by all three
    return materialize(chunking.chunk_fixed(canonical.canonical_text(texts), 20, 5)), canonical.page_offsets(texts), canonical.block_offsets(texts, t.blocks())


_PAGE_CHUNKS = "WITH" + _TEXTS + "," + _TOKENS.format(id="document_id", of="whole", stride=15, size=20)


@query(_PAGE_CHUNKS + 'SELECT c.document_id, c.ordinal, min(p.page_number) AS page_start, max(p.page_number) AS page_end FROM fixed c LEFT JOIN offs p ON p.document_id = c.document_id AND c.start < p."end" AND p.start < c."end" GROUP BY c.document_id, c.ordinal', "pages_")
def c7_chunk_pages(t: Tables) -> DataFrame:
    chunks, pages, _ = _page_chunks(t)
    return chunksets.chunk_pages(chunks, pages).select("document_id", "ordinal", "page_start", "page_end")


@query(_PAGE_CHUNKS + 'SELECT c.document_id, c.ordinal, coalesce(list(b.ordinal ORDER BY b.ordinal) FILTER (WHERE b.ordinal IS NOT NULL), []) AS block_ordinals FROM fixed c LEFT JOIN boffs b ON b.document_id = c.document_id AND c.start < b."end" AND b.start < c."end" GROUP BY c.document_id, c.ordinal', "pages_")
def c8_chunk_blocks(t: Tables) -> DataFrame:
    chunks, _, blocks = _page_chunks(t)
    return chunksets.chunk_blocks(chunks, blocks).select("document_id", "ordinal", "block_ordinals")


_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST((instr('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1 AS BIGINT), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"""SELECT doc_id, {_UUID.format(h='h')} AS id FROM (SELECT doc_id, sha1(unhex('{chunksets.CHUNK_NAMESPACE.replace('-', '')}')
    || encode('chunk:' || source || ':' || doc_id || ':0')) AS h
    FROM documents)""")
def c9_deterministic_ids(t: Tables) -> DataFrame:
    name = F.concat_ws(":", F.lit("chunk"), F.col("source"), F.col("doc_id").cast("string"), F.lit("0"))
    return t["documents"].select("doc_id", uuid5(chunksets.CHUNK_NAMESPACE, name).alias("id"))


_PRINT = """sha256('{\"cap\":32000,\"chunker\":\"fixed\",\"chunker_version\":\"1\",\"config\":\"200/20\",\"corpus_id\":\"' || corpus_id
    || '\",\"documents\":[' || string_agg('{\"document_id\":\"' || id || '\",\"parse_id\":\"' || parse_id || '\"}', ','
    ORDER BY uploaded_at, id) || '],\"tokenizer\":\"whitespace\"}')"""


@query(f"SELECT corpus_id, {_PRINT} AS fingerprint FROM docs GROUP BY corpus_id", "docs")
def c10_chunk_set_fingerprints(t: Tables) -> DataFrame:
    docs = t["docs"]
    return chunksets.chunk_set_fingerprints(docs, docs.select(F.col("id").alias("document_id"), "parse_id"), "200/20", "fixed", "whitespace")


@query("SELECT n_name AS fingerprint, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name < 'B') THEN 'reuse' ELSE 'build' END AS action FROM nation")
def c11_reuse_or_build(t: Tables) -> DataFrame:
    requests = t["nation"].select(F.col("n_name").alias("fingerprint"))
    known = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("fingerprint"),
        F.when(F.col("r_name") < "B", "ready").otherwise("failed").alias("status"))
    reuse, build = chunksets.split_reusable(requests, known)
    return reuse.withColumn("action", F.lit("reuse")).union(build.withColumn("action", F.lit("build")))


def _chunk_set(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sixteen corpora; those of a document whose number ends in 7 of 50 miss its parse."""
    texts = _texts(t)
    number = F.col("document_id").cast("long")
    whole = canonical.canonical_text(texts)
    names = (F.concat(F.lit("c"), number % 16).alias("corpus_id"), F.concat("document_id", F.lit(".md")).alias("original_filename"))
    docs = whole.select(F.col("document_id").alias("id"), *names, number.alias("uploaded_at"))
    parses = whole.where(number % 50 != 7).withColumn("parse_id", F.concat(F.lit("p"), "document_id"))
    chunker = lambda d: chunking.chunk_fixed(d, 20, 5)
    return chunksets.build_chunk_set(docs, parses, canonical.page_offsets(texts), canonical.block_offsets(texts, t.blocks()), chunker, "20/5", "fixed")


_CORPORA = """, corpora AS (SELECT 'c' || CAST(document_id AS BIGINT) % 16 AS corpus_id, bool_or(CAST(document_id AS BIGINT) % 50 = 7) AS missing FROM whole GROUP BY 1),
made AS (SELECT x.corpus_id, c.* FROM fixed c JOIN corpora x ON x.corpus_id = 'c' || CAST(c.document_id AS BIGINT) % 16 AND NOT missing)
"""


@query(_PAGE_CHUNKS + _CORPORA + """SELECT c.corpus_id, c.document_id AS source_document_id, c.ordinal, c.start, c."end", (SELECT min(page_number)
    FROM offs p WHERE p.document_id = c.document_id AND c.start < p."end" AND p.start < c."end") AS page_start,
    (SELECT max(page_number) FROM offs p WHERE p.document_id = c.document_id AND c.start < p."end" AND p.start < c."end") AS page_end,
    '{"block_ordinals":[' || coalesce((SELECT string_agg(ordinal, ',' ORDER BY ordinal) FROM boffs b WHERE b.document_id = c.document_id
    AND c.start < b."end" AND b.start < c."end"), '')
    || '],"original_filename":"' || c.document_id || '.md","parse_id":"p' || c.document_id || '"}' AS source_metadata FROM made c""", "pages_")
def c12_chunk_set(t: Tables) -> DataFrame:
    return _chunk_set(t)[0].select("corpus_id", "source_document_id", "ordinal", "start", "end", "page_start", "page_end", "source_metadata")


@query(_PAGE_CHUNKS + _CORPORA + """SELECT x.corpus_id, CASE WHEN missing THEN 'incomplete' ELSE 'ready' END AS status, NOT missing AS has_id, (SELECT count(*)
    FROM made m WHERE m.corpus_id = x.corpus_id) AS chunk_count FROM corpora x""", "pages_")
def c12_chunk_set_rows(t: Tables) -> DataFrame:
    return _chunk_set(t)[1].select("corpus_id", "status", F.col("chunk_set_id").isNotNull().alias("has_id"), "chunk_count")


# --- sources -----------------------------------------------------------------------------------------------------

_NAME = "CASE WHEN page_id % 11 = 0 THEN 'a/b.md' WHEN page_id % 5 = 0 THEN page_id || '.exe' ELSE page_id || '.MD' END"


@query(f"""SELECT page_id, CASE WHEN name = 'a/b.md' THEN 'invalid_filename' WHEN name LIKE '%.exe' THEN 'unsupported_file_type'
    WHEN strlen(html) * 5000 > 31457280 THEN 'file_too_large' END AS reject_code
    FROM (SELECT *, {_NAME} AS name FROM pages)""")
def a2_admission(t: Tables) -> DataFrame:
    name = F.when(F.col("page_id") % 11 == 0, "a/b.md").when(F.col("page_id") % 5 == 0,
        F.concat(F.col("page_id").cast("string"), F.lit(".exe"))).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".MD")))
    rows = t["pages"].select("page_id", name.alias("original_filename"), (F.octet_length("html").cast("long") * 5000).alias("size_bytes"))
    return files.admit_files(rows).select("page_id", "reject_code")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'text' WHEN 3 THEN 'markdown' END AS parser FROM documents")
def a4_parser_routing(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ("EPUB", "docx", "txt", "Md", "zip"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return t["documents"].select("doc_id", files.parser_for(ext).alias("parser"))


@query(r"SELECT page_id, md5(regexp_replace(html || chr(13) || chr(10) || 'end' || chr(13), chr(13) || chr(10) || '?', chr(10), 'g')) AS text FROM pages")
def a5_text_files(t: Tables) -> DataFrame:
    rows = t["pages"].select("page_id", F.encode(F.concat(F.col("html"), F.lit("\r\nend\r")), "UTF-8").alias("content"))
    return files.decode_text(rows).select("page_id", F.md5("text").alias("text"))


# --- vectors -----------------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(CASE WHEN source IN ('src0', 'src1') THEN 'search_document: ' || text ELSE text END) AS input FROM documents")
def d1_embedding_input(t: Tables) -> DataFrame:
    model = F.when(F.col("source").isin("src0", "src1"), "Nomic-Embed-Text-v1").otherwise("other")
    return t["documents"].select("doc_id", F.md5(vectors.embedding_input(F.col("text"), model, "document")).alias("input"))


#: The hashing embedder in SQL: the last 6 of the first 64 bits of a word's SHA-256 are its place, the first one its sign.
EMBEDDED = r"""ew AS (SELECT doc_id, sha256(unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS h FROM documents),
en AS (SELECT doc_id, CAST(('0x' || substr(h, 15, 2)) AS BIGINT) % 64 AS place, sum(CASE WHEN substr(h, 1, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM ew GROUP BY 1, 2),
el AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm, map_from_entries(list((place, n))) AS own FROM en GROUP BY 1),
embedded AS (SELECT d.doc_id, list_transform(range(64), lambda i: CAST(CASE WHEN coalesce(norm, 0) = 0 THEN 0 ELSE coalesce(own[i],
    0) / norm END AS FLOAT)) AS embedding FROM documents d LEFT JOIN el ON el.doc_id = d.doc_id)
"""


@query("WITH " + EMBEDDED + "SELECT * FROM embedded")
def d2_embeddings(t: Tables) -> DataFrame:
    return vectors.embed(t["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text")), vectors.hashing_embedder()).select("doc_id", "embedding")


@query("SELECT vec_id, CASE label WHEN 0 THEN 'empty_vector' WHEN 1 THEN 'wrong_dimensions' WHEN 2 THEN 'not_finite' END AS reject_code FROM embeddings")
def d3_vector_checks(t: Tables) -> DataFrame:
    e = F.col("embedding")
    broken = F.when(F.col("label") == 0, F.array().cast("array<float>")).when(F.col("label") == 1, F.slice(e, 1, 63)).when(F.col("label") == 2,
        F.concat(F.slice(e, 1, 63), F.array(F.lit("NaN").cast("float")))).otherwise(e)
    return vectors.validate_vectors(t["embeddings"].select("vec_id", broken.alias("embedding")), 64).select("vec_id", "reject_code")


@query("""SELECT CAST(label AS VARCHAR) AS index_id, count(*) AS chunk_count, count(*) FILTER (WHERE label <> 3 OR vec_id % 2 = 0) AS vector_count,
    count(*) = count(*) FILTER (WHERE label <> 3 OR vec_id % 2 = 0) AS complete
    FROM embeddings GROUP BY label""")
def d4_index_completeness(t: Tables) -> DataFrame:
    rows = t["embeddings"].select(F.col("label").cast("string").alias("index_id"), "vec_id", "label")
    return vectors.index_complete(rows, rows.where("label <> 3 or vec_id % 2 = 0"))


@query("""SELECT id, '{\"corpus_id\":\"' || corpus_id || '\",\"document_id\":\"' || id || '\",\"ordinal\":\"0\"' || CASE
    WHEN lang = 'en' THEN ',\"filename\":\"' || original_filename || '\"' ELSE '' END || '}' AS metadata
    FROM docs""", "docs")
def d5_vector_metadata(t: Tables) -> DataFrame:
    meta = vectors.vector_metadata(required={"corpus_id": F.col("corpus_id"), "document_id": F.col("id"), "ordinal": F.lit(0)},
        optional={"filename": F.when(F.col("lang") == "en", F.col("original_filename")), "page_start": F.lit(None).cast("int")})
    return t["docs"].select("id", F.to_json(meta).alias("metadata"))


@query("""SELECT id, sha256('{\"adapter\":\"local\",\"adapter_version\":\"1\",\"chunk_set_fingerprint\":\"' || parse_id || '\",\"chunk_set_id\":\"'
    || id || '\",\"dimensions\":64,\"metric\":\"cosine\",\"model\":' || coalesce('\"' || lang || '\"', 'null')
    || ',\"policy_version\":\"1\",\"provider\":\"local\",\"provider_model\":null,\"provider_revision\":' || CASE WHEN lang = 'en' THEN '\"'
    || corpus_id || '\"' ELSE 'null' END || ',\"store\":\"table\",\"store_version\":\"1\"}') AS fingerprint
    FROM docs""", "docs")
def d6_index_fingerprints(t: Tables) -> DataFrame:
    revision = F.when(F.col("lang") == "en", F.col("corpus_id"))
    found = vectors.vector_index_fingerprint(F.col("id"), F.col("parse_id"), model=F.col("lang"), dimensions=F.lit(64), provider_revision=revision)
    return t["docs"].select("id", found.alias("fingerprint"))


@query("""SELECT id, CASE WHEN lang = 'de' THEN 'index_not_ready' WHEN lang = 'fr' THEN 'model_mismatch'
    WHEN length(text) % 3 = 0 THEN 'query_width_mismatch' END AS reject_code
    FROM docs""", "docs")
def d7_compatible_indexes(t: Tables) -> DataFrame:
    fixed = {"provider": "local", "distance_metric": "cosine", "input_policy_version": "1", "indexer_name": "exact", "indexer_version": "1",
        "collection_name": "c"}
    rows = t["docs"].select("id", F.when(F.col("lang") == "de", "building").otherwise("ready").alias("status"),
        F.when(F.col("lang") == "fr", "b").otherwise("a").alias("model"),
        F.when(F.length("text") % 3 == 0, 32).otherwise(64).alias("dimensions"), F.lit(5).alias("vector_count"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return vectors.compatible_indexes(rows, fixed | {"model": "a", "dimensions": 64}).select("id", "reject_code")
