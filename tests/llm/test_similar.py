"""The near-duplicate stage against all pairs by brute force."""

import collections
import random

import corpus_pipeline
import pytest

from sparkcorpus.llm import similar

SCHEMA = "doc_id long, text string"


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def similar_pairs(sets, least=0.8):
    return [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= least]


def groups(n, pairs):
    root = list(range(n))
    while True:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return root


def edited(words, changes, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def copies():
    """Texts of 100 words, and copies with up to 5 new words: similarities from about 0.6 up."""
    rng, out = random.Random(5), []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        out += [" ".join(base)] + [" ".join(edited(base, rng.randint(0, 5), rng)) for _ in range(3)]
    return out


def test_stage_leaves_one_of_each_group(spark, copies):
    sets = [shingle_set(t) for t in copies]
    want = set(groups(len(copies), similar_pairs(sets)))
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(copies)), SCHEMA), "").collect()}
    assert got == want


def test_no_similar_pair_stays_of_large_nodes(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(base, rng.randint(0, 2), rng)) for _ in range(150)] + [" ".join(f"x{rng.random()}" for _ in range(50)) for _ in range(20)]
    got = [r.text for r in similar.drop_similar(spark.createDataFrame(list(enumerate(texts)), SCHEMA), node_size=16).collect()]
    assert not similar_pairs([shingle_set(t) for t in got]) and len(got) == 21


def test_rows_and_edges(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (3, b), (5, a.upper()), (None, b), (None, "c d"), (None, "c d"), (None, "c e"), (7, None), (8, " \n"), (9, "")]
    got = collections.Counter(map(tuple, similar.drop_similar(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == collections.Counter([(3, a), (3, b), (None, "c d"), (None, "c e"), (7, None)])
    assert similar.drop_similar(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def family():
    """A text of 200 words, 80 copies with one new word, and for each of them one with four more: the latter resemble their own copy
    (0.81), and no other (0.77)."""
    rng, texts = random.Random(9), []
    base = [f"w{i}" for i in range(200)]
    texts.append(" ".join(base))
    for _ in range(80):
        copy = edited(base, 1, rng)
        texts += [" ".join(copy), " ".join(edited(copy, 4, rng))]
    return texts


@pytest.mark.parametrize("node_size", [64, 1024])
def test_no_link_of_a_family_is_lost(spark, family, node_size):
    """Neither by forests of estimates in the wrong order, nor by leaders that leave."""
    want = set(groups(len(family), similar_pairs([shingle_set(t) for t in family])))
    got = {r.doc_id for r in similar.drop_similar(spark.createDataFrame(list(enumerate(family)), SCHEMA), node_size=node_size).collect()}
    assert got == want


def test_families_through_the_stage(spark, family):
    other = [t.replace("w", "v") for t in family]
    docs = [*enumerate(family), *enumerate(other, 1000)]
    want = {docs[i][0] for i in groups(len(docs), similar_pairs([shingle_set(t) for _, t in docs]))}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, SCHEMA), "").collect()} == want


@pytest.fixture
def calls(monkeypatch):
    """How often groups were found, and texts compared across groups."""
    counts = collections.Counter()
    for name in ("connected_components", "across"):
        def counted(*args, f=getattr(similar, name), name=name):
            counts[name] += 1
            return f(*args)

        monkeypatch.setattr(similar, name, counted)
    return counts


def test_groups_are_found_again_only_after_new_links(spark, copies, calls):
    """Each time is some ten queries, whose plans and threads the driver holds."""
    assert similar.drop_similar(spark.createDataFrame(list(enumerate(copies[:24])), SCHEMA)).count()
    assert calls == {"connected_components": 1, "across": 1}


def test_pairs_beyond_the_best_of_a_text_are_told(spark):
    """Three texts of one node, no two of one group, with equal estimates."""
    texts = spark.createDataFrame([(i, bytes(similar.PERMS), [7], i) for i in range(3)], "h long, sig binary, bands array<long>, root long")
    found = {best: {tuple(r) for r in similar.across(texts, 0.6, best=best).collect()} for best in (1, 2)}
    assert (None, None, 0, 7) in found[1]
    assert found[2] == {(1, 0, None, None), (2, 0, None, None), (2, 1, None, None)}


def test_pairs_of_large_nodes_are_checked_unlisted(spark, monkeypatch):
    """30 texts with 5 new words each of 200 (no link, many estimates near it), and one that is linked with the last of them."""
    rng, listed = random.Random(4), []
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(base, 5, rng)) for _ in range(30)]
    texts.append(" ".join(edited(texts[-1].split(), 3, rng)))
    f = similar.verified
    monkeypatch.setattr(similar, "verified", lambda edges, *args: (listed.append(edges.count()), f(edges, *args))[1])
    monkeypatch.setattr(similar, "candidates", lambda nodes, floor: nodes.select(nodes.h.alias("a"), nodes.h.alias("b")).limit(0))
    one = similar.across
    monkeypatch.setattr(similar, "across", lambda texts, floor, rows: one(texts, floor, rows, best=0))
    got = {r.doc_id for r in similar.drop_similar(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert got == set(groups(len(texts), similar_pairs([shingle_set(t) for t in texts]))) and sum(listed) == 0
