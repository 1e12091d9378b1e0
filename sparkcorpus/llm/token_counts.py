"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Totals are never recounted. A batch of changes (inserts, deletes, revised counts) is turned into signed rows, summed by
group, and committed as one small delta under its batch id; totals are the sum over committed deltas. A revision is
the old row with a minus and the new one with a plus, so a document that moves to another source or language takes its
tokens along. Sums are combined before the shuffle: a source with most rows is a few rows for each task.

Commits are idempotent. A delta is written under a name of its own and becomes visible by one rename to the folder of its
batch; a batch whose folder is there, or that a snapshot lists, is committed, and doing it again changes nothing. Of two
committers of one batch one wins. An attempt that dies leaves a folder that is never read. `compact` sums the deltas so
far into a snapshot, so that reading doesn't grow with the number of commits; one compaction may run at a time, beside
commits. The folder must be in a store whose rename is atomic.

Edge cases: null source, language or id are values of their own. A null text has 0 tokens; its document still counts. A
very long text is counted whole. Repeated rows with one id, or equal rows, count as often as they occur. A delete of an
unknown document is refused by `changes` (it compares states, so it can't arise there). Groups whose documents all went
stay with zero totals until `compact`. Other columns are not read. An empty table gives an empty delta, which is committed
like any other; without commits, totals are empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words

GROUP = ("source", "lang", "tokenizer")
#: Tokenizer versions that are built-in expressions: words, and words with each punctuation mark apart.
VERSIONS: Mapping[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.size(split_words(text)),
    "words-2": lambda text: F.size(split_words(text)) + F.length(text) - F.length(F.regexp_replace(text, r"[!-/:-@\[-`{-~]", "")),
}


def counted(docs: DataFrame, versions: Mapping[str, Callable[[Column], Column]] = VERSIONS, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Rows (id, source, lang, tokenizer, tokens): one for each document and tokenizer version."""
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    each = F.array(*(F.struct(F.lit(name).alias("tokenizer"), f(body).cast("long").alias("tokens")) for name, f in versions.items()))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"),
        F.explode(each).alias("c")).select("id", "source", "lang", "c.*")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.col("tokens"), F.lit(1).cast("long").alias("sign"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*GROUP, F.col("tokens"), F.lit(-1).cast("long").alias("sign"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that lead from one counted state to another; documents that are the same in both cancel out."""
    signed = old.select("id", *GROUP, "tokens", F.lit(-1).alias("sign")).union(new.select("id", *GROUP, "tokens", F.lit(1).alias("sign")))
    net = signed.groupBy("id", *GROUP, "tokens").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    return net.select(*GROUP, "tokens", "sign")


def rollup(signed: DataFrame) -> DataFrame:
    """Signed rows summed by group: documents and tokens, each added and removed."""
    amount = F.col("sign") * F.col("tokens")
    return signed.groupBy(*GROUP).agg(F.sum("sign").alias("docs"), F.sum(amount).alias("tokens"), F.sum(F.abs("sign")).alias("n_changes"))


class Ledger:
    """Committed deltas under a folder that Spark can read and write."""

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, n_changes long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _store(self):
        return self._path("delta").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """Names in one of the folders, sorted. Deltas are those since the last compaction, snapshots one or two."""
        path = self._path(kind)
        return sorted(x.getPath().getName() for x in self._store.listStatus(path)) if self._store.exists(path) else []

    def _publish(self, written: str, name: str) -> bool:
        """Rename what was written to its final name; False if that name is taken."""
        source, target = self._path(written), self._path(name)
        self._store.mkdirs(target.getParent())
        if self._store.exists(target):
            return False
        moved = self._store.rename(source, target)
        inside = self._path(f"{name}/{source.getName()}")  # where a rename to a folder that came up meanwhile has put it
        if self._store.exists(inside):
            self._store.delete(inside, True)
            return False
        return moved

    def _snapshot(self) -> tuple[int, DataFrame, DataFrame]:
        """(number, totals, names of the batches in them) of the last snapshot."""
        last = max((int(x) for x in self._names("snapshot")), default=0)
        at = f"{self.folder}/snapshot/{last:010d}"
        if not last:
            return 0, self.spark.createDataFrame([], self.SCHEMA), self.spark.createDataFrame([], "name string")
        return last, self.spark.read.schema(self.SCHEMA).parquet(f"{at}/totals"), self.spark.read.schema("name string").parquet(f"{at}/batches")

    def _open(self, batches: DataFrame) -> list[str]:
        """Names of the deltas that the snapshot doesn't hold."""
        names = self._names("delta")
        held = {r.name for r in batches.where(F.col("name").isin(names)).collect()} if names else set()
        return [x for x in names if x not in held]

    @staticmethod
    def _name(batch: str) -> str:
        return hashlib.sha256(batch.encode()).hexdigest()

    def committed(self, batch: str) -> bool:
        name = self._name(batch)
        return self._store.exists(self._path(f"delta/{name}")) or not self._snapshot()[2].where(F.col("name") == name).isEmpty()

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Sum and commit a batch of signed rows; False if it is committed already."""
        if self.committed(batch):
            return False
        attempt = f"attempt/{uuid.uuid4().hex}"
        rollup(signed).coalesce(1).write.parquet(f"{self.folder}/{attempt}")
        return self._publish(attempt, f"delta/{self._name(batch)}")

    def _sum(self, totals: DataFrame, names: list[str]) -> DataFrame:
        deltas = self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.folder}/delta/{x}" for x in names)) if names else totals.limit(0)
        return totals.union(deltas).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "n_changes")))

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, docs, tokens, n_changes) over all committed batches."""
        _, totals, batches = self._snapshot()
        return self._sum(totals, self._open(batches))

    def compact(self) -> None:
        """Put the deltas so far into a new snapshot and remove them. Groups without documents and tokens go."""
        last, totals, batches = self._snapshot()
        names, attempt = self._open(batches), f"attempt/{uuid.uuid4().hex}"
        self._sum(totals, names).where("docs <> 0 or tokens <> 0").coalesce(1).write.parquet(f"{self.folder}/{attempt}/totals")
        new = self.spark.createDataFrame([(x,) for x in names], "name string")
        batches.union(new).coalesce(1).write.parquet(f"{self.folder}/{attempt}/batches")
        if not self._publish(attempt, f"snapshot/{last + 1:010d}"):
            raise RuntimeError("another compaction was faster")
        for gone in [*(f"delta/{x}" for x in names), *([f"snapshot/{last:010d}"] if last else [])]:
            self._store.delete(self._path(gone), True)
