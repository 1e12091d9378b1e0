"""Files as documents: reading, admission, question sets, artifacts written once, exports."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, universal_newlines

#: Fixed limits and formats.
MAX_FILE_BYTES = 31_457_280
PARSERS = {"pdf": "pdf", "epub": "pdf", "mobi": "pdf", "docx": "docx", "pptx": "pptx", "txt": "text", "md": "markdown", "markdown": "markdown"}
ARCHIVE_MEMBERS = {"docx": ("[Content_Types].xml", "word/document.xml"), "pptx": ("[Content_Types].xml", "ppt/presentation.xml"), "epub": ("mimetype",)}
QUESTION_SCHEMA = "struct<examples:array<struct<question:string,reference_answer:string,relevant_documents:array<string>>>>"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def read_documents(spark: SparkSession, path: str, corpus_id: str) -> DataFrame:
    """One row for each file: name, extension, size, SHA-256 and content."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(
        F.lit(corpus_id).alias("corpus_id"), name.alias("original_filename"), extension(name).alias("extension"),
            F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_sha256"), F.col("modificationTime").alias("uploaded_at"), "content"
    )


def parser_for(ext: Column) -> Column:
    """Parser family of an extension; null if there is none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in PARSERS.items() for x in kv)), F.lower(ext))


def content_matches_format(content: Column, ext: Column) -> Column:
    """Whether the bytes look like what the extension says. Archives' member lists are read by a vectorised helper."""

    @F.pandas_udf("boolean")
    def has_members(data: pd.Series, kind: pd.Series) -> pd.Series:
        def has(raw: bytes | None, ext: str | None) -> bool:
            try:
                return set(ARCHIVE_MEMBERS[ext]) <= set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
            except (zipfile.BadZipFile, KeyError, TypeError, ValueError):
                return False

        return pd.Series([has(d, k) for d, k in zip(data, kind, strict=True)])

    head = lambda at, text: F.coalesce(F.substring(content, at, len(text)) == F.encode(F.lit(text), "UTF-8"), F.lit(False))
    archive = ext.isin(*ARCHIVE_MEMBERS)
    text = F.coalesce(F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\x00")), F.lit(False))
    return (
        F.when(ext == "pdf", head(1, "%PDF-")).when(ext == "mobi", head(61, "BOOKMOBI"))
        .when(archive, head(1, "PK") & has_members(F.when(archive, content), ext)).when(ext.isin("txt", "md", "markdown"), text).otherwise(False)
    )


def reject_code(name: Column, size: Column, content_ok: Column | None = None) -> Column:
    """The first rule that a file fails, null if it is admitted."""
    bad_name = is_blank(name) | name.isin(".", "..") | name.rlike(r"[/\\]")
    code = F.when(bad_name, "invalid_filename").when(parser_for(extension(name)).isNull(), "unsupported_file_type").when(size > MAX_FILE_BYTES,
        "file_too_large")
    return code if content_ok is None else code.when(~content_ok, "invalid_file_content")


def admit_files(files: DataFrame, batch: str | None = None, content_ok: Column | None = None) -> DataFrame:
    """Adds reject_code, and batch_admitted: whether the whole batch has no rejected file."""
    coded = files.withColumn("reject_code", reject_code(F.col("original_filename"), F.col("size_bytes"), content_ok))
    if batch is None:
        return coded
    flags = coded.groupBy(F.col(batch).alias("__batch")).agg((F.count("reject_code") == 0).alias("batch_admitted"))
    return coded.join(flags, F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")


def decode_text(files: DataFrame) -> DataFrame:
    """Adds text: the content as UTF-8 with universal newlines."""
    return files.withColumn("text", universal_newlines(F.decode("content", "UTF-8")))


def read_text_documents(spark: SparkSession, path: str, corpus_id: str = "default") -> DataFrame:
    """Text and markdown files; such a document has no pages and no blocks."""
    return decode_text(read_documents(spark, path, corpus_id).where(parser_for(F.col("extension")).isin("text", "markdown"))).drop("content")


def read_question_sets(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, ordinal, question, reference_answer, relevant_documents, error). A bad file is one row with an error."""
    raw = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length",
        F.col("content").cast("string").alias("text"))
    return parse_question_sets(raw)


def parse_question_sets(raw: DataFrame) -> DataFrame:
    """As read_question_sets, from rows (file, length, text)."""
    root = F.from_json("text", QUESTION_SCHEMA, {"mode": "PERMISSIVE"})
    items = F.from_json(F.get_json_object("text", "$.examples"), "array<string>")
    known = F.array(*map(F.lit, ("question", "reference_answer", "relevant_documents")))
    unknown = F.coalesce(F.exists(items, lambda x: F.coalesce(F.size(F.array_except(F.json_object_keys(x), known)) > 0, F.lit(True))),
        F.lit(False)) | ~F.coalesce(F.array_except(F.json_object_keys("text"), F.array(F.lit("examples"))) == F.array().cast("array<string>"), F.lit(False))
    examples = root["examples"]
    # values are texts, the answer may be null, and documents are a list of texts if they are there
    kind = lambda x, path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), path, "variant"))
    has = lambda x, name: F.coalesce(F.array_contains(F.json_object_keys(x), name), F.lit(False))
    odd = lambda x: (
        ~F.coalesce(kind(x, "$.question") == "STRING", F.lit(False))
        | (has(x, "reference_answer") & ~F.coalesce(kind(x, "$.reference_answer").isin("STRING", "VOID"), F.lit(False)))
        | (has(x, "relevant_documents") & ~F.coalesce(kind(x, "$.relevant_documents").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)))
    )
    error = F.when(F.col("length") > MAX_FILE_BYTES, "file_too_large").when(~F.is_valid_utf8("text"),
        "bad_encoding").when(F.try_parse_json("text").isNull(), "bad_json").when(unknown, "unknown_field").when(F.exists(items, odd),
        "wrong_type").when(F.coalesce(F.size(examples), F.lit(0)) < 1, "no_examples").when(F.exists(examples, lambda e: is_blank(e["question"])),
        "blank_question")
    rows = raw.select("file", error.alias("error"), examples.alias("examples"))
    good = rows.where("error is null").select("file", F.posexplode("examples").alias("ordinal", "e")).select("file", "ordinal", "e.*",
        F.lit(None).cast("string").alias("error"))
    bad = rows.where("error is not null").select("file", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("question"),
        F.lit(None).cast("string").alias("reference_answer"), F.lit(None).cast("array<string>").alias("relevant_documents"), "error")
    return good.unionByName(bad)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Move a folder to a place that nothing has yet. False if it's taken, also by another writer at the same time."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(target).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place(target).getParent())
    if store.exists(place(target)):
        return False
    store.rename(place(source), place(target))
    inside = place(f"{target}/{source.rpartition('/')[2]}")  # a rename beside another one ends here
    return not (store.exists(inside) and store.delete(inside, True))


def _named(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def publish(spark: SparkSession, path: str, row: dict[str, str]) -> bool:
    """Make an artifact visible by its manifest row, which has fingerprint and artifact_id. False if the fingerprint is
    published already. Fails if the id belongs to another fingerprint: it does from the first attempt to publish it.

    Each step is one rename of a folder, so that of several writers one gets through.
    """
    attempt = f"{path}/attempts/{uuid.uuid4().hex}"
    claim, target = f"{path}/ids/id={_named(row['artifact_id'])}", f"{path}/manifest/print={_named(row['fingerprint'])}"
    spark.createDataFrame([(row["fingerprint"],)], "fingerprint string").coalesce(1).write.parquet(f"{attempt}-id")
    if not _renamed(spark, f"{attempt}-id", claim):
        owner = spark.read.schema("fingerprint string").parquet(claim).first()
        if owner is None or owner["fingerprint"] != row["fingerprint"]:
            raise ValueError(f"artifact id {row['artifact_id']} belongs to another fingerprint")
    spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.parquet(attempt)
    return _renamed(spark, attempt, target)


def published(spark: SparkSession, path: str, fingerprint: str) -> dict[str, str] | None:
    """The manifest row of a fingerprint."""
    known = read_manifest(spark, path)
    found = None if known is None else known.where(F.col("fingerprint") == fingerprint).first()
    return None if found is None else found.asDict()


def write_artifact(df: DataFrame, path: str, artifact_id: str, manifest: dict[str, str]) -> bool:
    """Write the rows of an artifact and publish them. False if its fingerprint is there already.

    Rows go to a folder of this attempt, which the manifest row names; nothing that is visible is ever written again. An attempt that
    comes second, or fails, leaves its folder out of sight.
    """
    spark, fingerprint = df.sparkSession, manifest["fingerprint"]
    if published(spark, path, fingerprint) is not None:
        return False
    attempt = uuid.uuid4().hex
    target = f"{path}/rows/attempt={attempt}"
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.parquet(target)
    count = spark.read.schema(df.schema).parquet(target).count()
    if count != seen.get["rows"]:
        raise RuntimeError(f"{count} rows are there of {seen.get['rows']} that were written")
    return publish(spark, path, {**manifest, "artifact_id": artifact_id, "attempt": attempt, "row_count": str(count), "status": "ready"})


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.option("mergeSchema", True).parquet(f"{path}/manifest").drop("print")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the artifacts that have a manifest row, with artifact_id; only the folders of their attempts are read. Fails if
    nothing was ever written."""
    rows, manifest = spark.read.parquet(f"{path}/rows"), read_manifest(spark, path)
    if manifest is None:
        return rows.limit(0).withColumn("artifact_id", F.lit(None).cast("string")).drop("attempt")
    return rows.withColumn("attempt", F.col("attempt").cast("string")).join(manifest.select("attempt", "artifact_id"), "attempt").drop("attempt")


def export_runs(runs: DataFrame, path: str) -> None:
    """One JSON object for each run, in order of id."""
    runs.orderBy("id").write.mode("overwrite").json(path)


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Cut frames into parts of at most `size` rows."""
    for frame in frames:
        for a in range(0, len(frame), size):
            yield frame.iloc[a : a + size]
