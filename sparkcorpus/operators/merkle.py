"""Fingerprints of corpora as trees of hashes that are kept, so that a few new documents rehash a few paths.

A document's leaf is the SHA-256 of its id, its parse and its time of upload, which is its place in the order of the corpus.
Leaves lie in 16**DEPTH buckets by the first hexadecimal digits of the SHA-256 of the document's id. A node of the last
level hashes the leaves of its bucket, in order; a node above hashes its children, 16 at most, in order of their digits. The
root, and all else that decides the chunks, make the fingerprint of the corpus's chunk set.

Leaves and nodes are tables. To add documents, or to parse some again, the buckets that they fall in are hashed again, and
the nodes on the ways from there to the root: DEPTH + 1 for one document, however large the corpus. No task reads a corpus;
the largest row is a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint

#: Digits of a bucket. 16**4 buckets hold some 15,000 documents each in a corpus of 10**9.
DEPTH = 4


def leaves(documents: DataFrame, parses: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (corpus_id, document_id, place, h) of the parsed documents: documents (id, corpus_id, uploaded_at), parses
    (document_id, parse_id)."""
    rows = documents.select("corpus_id", F.col("id").alias("document_id"), "uploaded_at").join(parses.select("document_id", "parse_id"), "document_id")
    place = F.substring(F.sha2(F.col("document_id").cast("string"), 256), 1, depth)
    return rows.select("corpus_id", "document_id", place.alias("place"), fingerprint(F.struct("document_id", "parse_id", "uploaded_at")).alias("h"))


def _over(rows: DataFrame, order: str) -> DataFrame:
    """Rows (corpus_id, place, h): one hash over the hashes of a place, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"])
    return rows.groupBy("corpus_id", "place").agg(F.sha2(F.array_join(listed, ","), 256).alias("h"))


def _above(nodes: DataFrame) -> DataFrame:
    return _over(nodes.select("corpus_id", F.col("place").alias("child"), F.substring("place", F.lit(1), F.length("place") - 1).alias("place"), "h"), "child")


def tree(own: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (corpus_id, place, h), one for each node over the leaves; a root's place is the empty text."""
    level = _over(own, "document_id")
    nodes = level
    for _ in range(depth):
        level = _above(level)
        nodes = nodes.union(level)
    return nodes


def rehashed(nodes: DataFrame, own: DataFrame, new: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The nodes that change when leaves `new` come to the leaves `own` of a tree, or replace those of their documents."""
    places = new.select("corpus_id", "place").distinct()
    stay = own.join(places, ["corpus_id", "place"], "left_semi").join(new.select("corpus_id", "document_id"), ["corpus_id", "document_id"], "left_anti")
    level = _over(stay.unionByName(new), "document_id")
    out = level
    for k in range(depth - 1, -1, -1):
        parents = level.select("corpus_id", F.substring("place", 1, k).alias("parent")).distinct()
        near = nodes.where(F.length("place") == k + 1).withColumn("parent", F.substring("place", 1, k)).join(parents, ["corpus_id", "parent"], "left_semi")
        children = near.drop("parent").join(level.select("corpus_id", "place"), ["corpus_id", "place"], "left_anti").unionByName(level)
        level = _above(children)
        out = out.union(level)
    return out


def grown(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """The nodes of the tree with those that changed."""
    return nodes.join(changed.select("corpus_id", "place"), ["corpus_id", "place"], "left_anti").unionByName(changed)


def set_fingerprints(nodes: DataFrame, config: str, chunker: str, tokenizer: str, version: str, cap: int = 32_000) -> DataFrame:
    """Rows (corpus_id, fingerprint): of the chunk sets that these settings make from the corpora."""
    text: dict[str, Column] = {"cap": F.lit(cap), "chunker": F.lit(chunker), "chunker_version": F.lit(version), "config": F.lit(config),
        "corpus_id": F.col("corpus_id"), "root": F.col("h"), "tokenizer": F.lit(tokenizer)}
    return nodes.where("place = ''").select("corpus_id", fingerprint(F.struct(*(c.alias(k) for k, c in text.items()))).alias("fingerprint"))
