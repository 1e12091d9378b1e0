"""Trees of hashes of corpora: what changes when documents come."""

import hashlib

from pyspark.sql import functions as F

from sparkcorpus.operators import merkle

DEPTH = 3


def corpora(spark, ids, parse="p"):
    docs = spark.createDataFrame([(f"d{i}", "big" if i % 5 else None, i % 7) for i in ids], "id string, corpus_id string, uploaded_at long")
    return docs, docs.select(F.col("id").alias("document_id"), F.concat(F.lit(parse), "id").alias("parse_id"))


def leaves(spark, ids, parse="p"):
    return merkle.leaves(*corpora(spark, ids, parse), depth=DEPTH)


def slow_root(rows):
    """Root of one corpus from rows (document_id, h)."""

    def node(prefix):
        if len(prefix) == DEPTH:
            inside = sorted((d, h) for d, h in rows if hashlib.sha256(d.encode()).hexdigest().startswith(prefix))
        else:
            inside = [(c, h) for c in "0123456789abcdef" if (h := node(prefix + c))]
        return hashlib.sha256(",".join(h for _, h in inside).encode()).hexdigest() if inside else None

    return node("")


def nodes_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_tree_is_the_slow_one(spark):
    own = leaves(spark, range(400))
    roots = {r.corpus_id: r.h for r in merkle.tree(own, DEPTH).where("place = ''").collect()}
    rows = own.collect()
    assert roots == {c: slow_root([(r.document_id, r.h) for r in rows if r.corpus_id == c]) for c in ("big",)} | {None: roots[None]}
    assert roots[None] == slow_root([(r.document_id, r.h) for r in rows if r.corpus_id is None])


def test_one_document_rehashes_one_path(spark):
    own = leaves(spark, range(1, 400))
    before = spark.createDataFrame(merkle.tree(own, DEPTH).collect(), "corpus_id string, place string, h string")
    changed = merkle.rehashed(before.where("corpus_id is not null"), own.where("corpus_id is not null"), leaves(spark, [1001]), DEPTH)
    assert changed.count() == DEPTH + 1  # of some 3,000 nodes
    assert nodes_of(merkle.grown(before.where("corpus_id is not null"), changed)) == nodes_of(merkle.tree(leaves(spark, [*range(1, 400), 1001]).where("corpus_id is not null"), DEPTH))


def test_a_document_that_is_parsed_again(spark):
    ids = [i for i in range(300) if i % 5]
    own = leaves(spark, ids)
    before = spark.createDataFrame(merkle.tree(own, DEPTH).collect(), "corpus_id string, place string, h string")
    again = leaves(spark, [7, 11], parse="q")
    changed = merkle.rehashed(before, own, again, DEPTH)
    after = merkle.grown(before, changed)
    want = merkle.tree(leaves(spark, [i for i in ids if i not in (7, 11)]).union(again), DEPTH)
    assert nodes_of(after) == nodes_of(want) and changed.count() <= 2 * DEPTH + 1
    prints = lambda nodes, config: {r.corpus_id: r.fingerprint for r in merkle.set_fingerprints(nodes, config, "x", "t", "1").collect()}
    assert prints(before, "c") != prints(after, "c") == prints(want, "c") != prints(want, "d")


def test_no_task_reads_a_corpus(spark):
    """What is gathered is the bucket or the children of a node."""
    own = leaves(spark, range(2000))
    assert own.groupBy("corpus_id", "place").count().agg(F.max("count")).first()[0] < 10
    assert merkle.tree(own.limit(0), DEPTH).count() == 0
