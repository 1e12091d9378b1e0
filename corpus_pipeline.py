"""From raw documents to token files: five stages, each written as Parquet and read again by the next one.

Edge cases. Rows are told apart by id and text, so null and repeated ids decide nothing for other rows. Null and wordless
texts are rejected by the first stage; given to a later one, they are copies of each other (one stays), hold no leak, are
never taken by the mix, and give the end id alone. Very long texts go through whole. Of rows equal in id and text near-dedup
keeps one; of near copies, the smallest id, null ids last. All columns are kept, whatever their names, up to the last stage.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkcorpus.llm import decontamination, mixing, near_dedup, quality_rules, token_files
from sparkcorpus.llm.common import shared_folder
from sparkcorpus.llm.queries import END_ID, TOKENIZER, quality_weights, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go. Rows are judged alone, so repeated rows stay or go together."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, similarity of 0.8 or more.

    Candidates are those of operator 3's index, and of bands for what its radius can't reach; each is verified.
    """
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. An empty benchmark removes nothing."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is one more source; without labels all weigh the same."""
    return mixing.mixed_documents(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left, read back, in order of id; null ids come first."""
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("mixing", mix), ("token_files", tokens)]

#: SQL has neither the fingerprints nor the tokenizer; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
