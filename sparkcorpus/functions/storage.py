"""Cutting lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as a URI. Only a local master may use a folder of its own machine instead."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return (folder or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """The rows, computed once and read back from a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def bounded(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Actions in here hand rows to Python in batches of about `most` bytes, one row at least, and remove their shuffle files when
    they end. Choices of the session stay."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(most), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    wanted = {k: v for k, v in wanted.items() if spark.conf.get(k, None) in (None, "false")}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
