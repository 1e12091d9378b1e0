"""The test tables as tables of the data model: each view as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    # a source is a corpus; some file names occur twice in a corpus
    "docs": "SELECT CAST(doc_id AS STRING) AS id, source AS corpus_id, concat('doc_', CAST(doc_id % 390 AS STRING), '.txt') AS original_filename, concat('p', CAST(doc_id AS STRING)) AS parse_id, lang, text, doc_id AS uploaded_at FROM documents",
    "pages_": "SELECT CAST(conv_id AS STRING) AS document_id, CAST(turn + 1 AS INT) AS page_number, text FROM conversations",
    "vectors": "SELECT CAST(vec_id AS STRING) AS chunk_id, vec_id, embedding, label FROM embeddings",
    # every fifth question has no label
    "questions": "SELECT CAST(vec_id AS STRING) AS query_id, vec_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0",
    "labels_": "SELECT query_id AS example_id, label AS document_id FROM questions WHERE (vec_id / 100) % 5 <> 4 UNION ALL SELECT query_id, (label + 1) % 10 FROM questions WHERE (vec_id / 100) % 5 <> 4",
    # a user is a run and an event one of its examples
    "example_runs": "SELECT CAST(event_id AS STRING) AS id, CAST(user_id AS STRING) AS run_id, event_id AS ordinal, CASE event_type WHEN 'click' THEN 'completed' WHEN 'view' THEN 'pending' WHEN 'purchase' THEN 'failed' ELSE 'running' END AS status, event_type AS question, CASE WHEN event_type <> 'view' THEN value END AS retrieval_ms, CASE WHEN event_type = 'click' THEN value END AS generation_ms, CASE WHEN event_type <> 'click' THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS tokens FROM events",
    "runs": "SELECT CAST(user_id AS STRING) AS id, user_id AS created_at, CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, count(*) AS total_examples, count_if(event_type = 'click') AS completed_examples, max(event_id) AS duration_ms FROM events GROUP BY user_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The tables of a folder and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.sf_dir, name)
        if name == "labels_":
            q = self["questions"].where("(vec_id div 100) % 5 <> 4")
            return q.select(F.col("query_id").alias("example_id"), F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10)).alias("document_id"))
        base = VIEWS[name].rsplit(" FROM ", 1)[1].split()[0]
        return self.spark.sql(VIEWS[name].replace(f" FROM {base}", " FROM {base}"), base=self[base])

    def blocks(self) -> DataFrame:
        """Lines of a page."""
        return self["pages_"].select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))


def with_views(sql: str, *names: str) -> str:
    """The SQL with the named views before it, in DuckDB's dialect."""
    wanted = [n for n in VIEWS if n in names]
    text = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    text = text.replace("AS STRING)", "AS VARCHAR)").replace("get_json_object(props, '$.k')",
        "json_extract_string(props, '$.k')").replace("(vec_id / 100)", "(vec_id // 100)")
    head, _, rest = sql.strip().partition("WITH")
    return f"WITH {text}, {rest}" if not head and rest else f"WITH {text} {sql}"
