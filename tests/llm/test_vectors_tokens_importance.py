"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkcorpus.llm import alignment, importance, queries, vector_graph

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- nearest vectors ---------------------------------------------------------------------------------------------


def plain_nearest(rows, k):
    """For each usable row with an id divisible by 20: (id, score) of the nearest k, from all pairs."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            near = sorted((-(v * q).sum(), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_nearest_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want = plain_nearest(rows, 20)
    got = {}
    for r in queries.op11_nearest_vectors(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for i, near in got.items():
        assert [x[0] for x in near] == [*range(1, 21)] and [-x[2] for x in near] == sorted(-x[2] for x in near)
        hits += len({x[1] for x in near} & {j for j, _ in want[i]})
        exact = {j: s for j, s in want[i]}
        assert all(x[2] == exact[x[1]] for x in near if x[1] in exact)
    assert hits >= 0.95 * 20 * len(want)


def test_graph_of_long_and_short_vectors():
    """Lengths differ by a factor of 20: the inner product isn't the angle."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 4, size=(3000, 1))
    graph = vector_graph.build(x, rng.integers(0, 1 << 63, 3000, np.uint64))
    q = rng.normal(size=(100, 24))
    found, score = vector_graph.search(graph, q, 10)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert sum(len({*a.tolist()} & {*b.tolist()}) for a, b in zip(found, true, strict=True)) >= 950
    assert np.allclose(score, np.take_along_axis(q @ x.T, found, axis=1))
    members, neighbours = graph.layers[0]
    assert members.tolist() == [*range(3000)] and neighbours.shape == (3000, 2 * vector_graph.LINKS)


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 0.0]), (60, None), (80, [nan, 1.0]), (81, [inf, 1.0]),
        (100, [1.0, None]), (120, [1.0, 2.0, 3.0]), (5, [2.0, 1.0, 0.0]), (None, [1.0, 1.0]), (7, [-3.0, 1.0]), (140, [2.0, 1.0]), (9, [5.0, 1.0]), (160, [])]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in vector_graph.nearest(table, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == plain_nearest([r for i, r in enumerate(rows) if i != 4], 3)
    assert vector_graph.nearest(table.limit(0), F.col("id") % 20 == 0, 3).count() == 0


def test_nearest_equal_vectors_in_many_shards(spark):
    rows = [(i, [1.0, float(i // 500), float(i % 3 == 0)]) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vector_graph.nearest(table, F.col("id") % 20 == 0, 20, shard_rows=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == plain_nearest(rows, 20)


# --- two tokenizers ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_aligned():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    value, name = alignment.byte_values(), {i: t for t, i in a.get_vocab().items()}

    def run(text):
        """(A ids, B ids, groups as text, links) of a whole text, links from all pairs."""
        if not text:
            return None
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        p = [bytes(value[c] for c in name[i]) for i in x]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(p) == b"".join(q) == f" {text}".encode():
            return None
        edge = lambda parts: [0, *np.cumsum([*map(len, parts)]).tolist()]
        p, q = edge(p), edge(q)
        cuts = sorted({*p} & {*q})
        inside = lambda ids, at, lo, hi: ",".join(str(i) for i, s in zip(ids, at, strict=False) if lo <= s < hi)
        groups = ";".join(f"{inside(x, p, lo, hi)}|{inside(y, q, lo, hi)}" for lo, hi in zip(cuts, cuts[1:], strict=False))
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if p[i] < q[j + 1] and q[j] < p[i + 1]]
        return x, y, groups, links

    return run


def plain_statistics(rows, run):
    found, n, most = [run(t) for _, t in rows], Counter(), {}
    for f in found:
        n.update(f[3] if f else [])
    for (_, b), c in n.items():
        most[b] = max(most.get(b, 0), c)
    return [(i, len(f[0]), len(f[1]), f[2].count("|"), len(f[3]), sum(n[x] == most[x[1]] for x in f[3]), sum(n[x] for x in f[3]),
        hashlib.sha256(f[2].encode()).hexdigest()) if f else (i, 0, 0, 0, 0, 0, 0, "") for (i, _), f in zip(rows, found, strict=True)]


ODD = [None, "", " ", "  ", "a", " a", "a  b", "x y", "▁a b", "a ▁", "<|endoftext|> x", "<s> </s>", "日本語 テスト 🙂🙂 é ﬁ", "a\x1cb c", "tab\tx y\n\nz ",
    "don't can't 123 4567 ... !!", "\x00 b", "A" * 300 + " " + "b" * 50, "same same same", "same same same", "Trans-Siberian; (über) naïve ½ ²³ x́y ́ z"]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("pieces", [True, False])
def test_alignment_of_odd_texts(spark, plain_aligned, pieces):
    rows = [*enumerate(ODD), (None, "a null id"), (3, "a repeated id")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int")
    own = alignment.Aligner(A, B)
    own.pieces = pieces
    found, of, groups = own.texts(pa.array([t for _, t in rows]))
    for (_, text), at in zip(rows, of, strict=True):
        want = plain_aligned(text)
        assert b"".join(groups[i] for i in at)[:-1].decode() == (want[2] if want else "")
        places = alignment.spread(found.link_at[at], found.link_at[at + 1] - found.link_at[at])
        assert Counter(found.links[places].tolist()) == Counter((a << 32) + b for a, b in (want[3] if want else []))
    got = alignment.statistics(table, A, B).collect()
    assert key(map(tuple, got)) == key(plain_statistics(rows, plain_aligned))


def test_alignment_of_documents(spark, plain_aligned):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert key(map(tuple, alignment.statistics(table, A, B).collect())) == key(plain_statistics(rows, plain_aligned))
    for r in alignment.alignments(table.limit(20), A, B).collect():
        want = plain_aligned(dict(rows)[r.id])
        assert (r.a, r.b) == (want[0], want[1]) if want else not r.a
        cut = lambda ids, ends: [",".join(map(str, ids[x:y])) for x, y in zip([0, *ends], ends, strict=False)]
        assert not want or ";".join(map("|".join, zip(cut(r.a, r.a_ends), cut(r.b, r.b_ends), strict=True))) == want[2]


def test_alignment_of_many_blocks_in_a_task(spark, plain_aligned, monkeypatch):
    """Rows are short and batches bounded, however many blocks a task has."""
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").coalesce(1)
    rows, limits = [(r.doc_id, r.text) for r in table.collect()], []
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    write = alignment.written
    monkeypatch.setattr(alignment, "written", lambda df, name: limits.append((name, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None))) or write(df, name))
    got = alignment.statistics(table, A, B)
    assert key(map(tuple, got.collect())) == key(plain_statistics(rows, plain_aligned))
    assert limits == [("aligned", "2000"), ("pair-counts", "2000"), ("alignment", "2000")] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    made = alignment.blocks(table, A, B)
    assert not any(kind.startswith("array") for _, kind in made.dtypes)
    assert made.where("body is not null").count() > 10


def test_alignment_of_nothing(spark):
    assert alignment.statistics(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


# --- importance --------------------------------------------------------------------------------------------------


def plain_resample(rows, targets, seed=42):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    own, s, t, out = [(i, *features(x)) for i, x in rows], Counter(), Counter(), []
    for _, _, c in own:
        s.update(c)
    for x in targets:
        t.update(features(x)[1])
    both = (s.total() + 10000, t.total() + 10000)
    gain = [math.floor(1000 * math.log((t[b] + 1) * both[0] / ((s[b] + 1) * both[1]))) for b in range(10000)]
    for i, n, c in own:
        weight = sum(gain[b] * m for b, m in c.items())
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_importance_of_documents(spark, sf):
    read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    got = [tuple(r) for r in queries.op13_importance_resampling(spark, f"/root/testdata/{sf}").collect()]
    want = plain_resample([(r.doc_id, r.text) for r in read("documents").collect()], [r.text for r in read("benchmark").collect()])
    assert key(got) == key(want)
    drawn = importance.drawn(read("documents"), read("benchmark")).collect()
    assert sorted(r.doc_id for r in drawn) == sorted(r[0] for r in want if r[4])


def test_importance_of_odd_rows(spark, monkeypatch):
    long = " ".join(f"w{i % 7}é" for i in range(3000))
    texts = [None, "", "!!", "ÀÉ STRASSE-Straße x_y\x00z 日本", long, "x" * 5000 + " " + "y" * 70, "a b c " * 30, *["copy of a text " * 9] * 60]
    rows = [*enumerate(texts), (None, long), (3, long + " more"), (None, long)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    target = spark.createDataFrame([("copy of w1é",), (None,)], "text string")
    got = [(r.id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(table, target).collect()]
    assert key(got) == key(plain_resample(rows, ["copy of w1é", None]))
    drawn = importance.drawn(table, target)
    assert drawn.columns == table.columns and drawn.count() == sum(g[4] is not None for g in got) == 3
    assert importance.resample(table.limit(0), target).count() == 0
    assert {r.weight for r in importance.resample(table.limit(1), target.limit(0)).collect()} == {0}
    monkeypatch.setattr(importance, "FEATURES", 100)  # a long text in slices
    monkeypatch.setattr(importance, "DOCS", 3)
    runs = importance.Runs(pa.array(texts))
    counts = np.concatenate([*runs.counts()])
    assert (counts.sum(axis=0) == runs.totals()).all() and counts.sum(axis=1).tolist() == [sum(max(n - k, 0) for k in range(3)) for n in runs.words]


def test_importance_ranks_over_ranges(spark, monkeypatch):
    """Ranks go on over the ranges of scores, copies included."""
    monkeypatch.setattr(importance, "RANGE_ROWS", 50)
    rows = spark.range(1000).select((F.col("id") % 300).alias("id"), F.lit(0).cast("long").alias("h"), F.lit(30).cast("long").alias("n_words"),
        F.lit(1).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 300 % 9).alias("score"))
    got = [(r.score, r.id, r["rank"]) for r in importance.ranked(rows, 600).collect()]
    want = sorted((r.score, r.id) for r in rows.collect())
    want.sort(key=lambda r: (-r[0], r[1]))
    assert sorted(got, key=lambda r: (-r[0], r[1], r[2] or 9999)) == [(*r, i if i <= 600 else None) for i, r in enumerate(want, 1)]
