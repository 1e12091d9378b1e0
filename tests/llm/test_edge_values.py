"""What each operator gives for nulls, empty and very long texts, ties and repeated rows, beside columns of clashing names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcorpus.llm import decontamination, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secrets, token_counts, token_files

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None, None, None), (2, "", "s", "en"), (3, " \n\t", "s", "en"), (4, "a", "s", None), (4, "a", "s", None), (None, "x y z w v u", "t", "de"), (5, LONG, "t", "de"), (6, LONG, None, "de"), (7, "one two three four five six", "t", "en")]
CLASH = ("id", "fp", "key", "count", "size", "n", "row", "words", "line", "first", "of", "out", "h", "u", "copies", "votes", "score", "lead", "other")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def by_id(rows, *columns):
    return sorted(((r[0], *(r[c] for c in columns)) for r in rows), key=lambda x: (x[0] is not None, x))


def test_near_duplicates(odd):
    rows = near_dedup.near_duplicates(odd).collect()
    got = by_id(rows, "component")
    # the texts without words, and the copies, are components; a lone row without id has none to name it
    assert got == [(None, None), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 5), (7, 7)]
    assert {r.fp for r in rows if r.id in (1, 2, 3)} == {0}


def test_one_of_each_group_stays(odd):
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and by_id(kept.select("doc_id").collect()) == [(None,), (1,), (4,), (5,), (7,)]


def test_lines(odd):
    """The second long text is an equal line and goes; equal rows are no earlier lines of each other."""
    assert [tuple(r) for r in line_dedup.matches(odd).collect()] == [(6, 0, 5, 0, 0)]
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and {r.doc_id: r.text for r in out.collect() if r.doc_id in (1, 3, 6)} == {1: None, 3: " \n\t", 6: ""}


def test_leaks(odd):
    items = odd.withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id, r.similarity, r.start) for r in decontamination.leaks(odd, items).collect()}
    assert got == {(a, b, 1.0, 0) for a in (5, 6) for b in (5, 6)} | {(None, None, 1.0, 0), (7, 7, 1.0, 0)}
    kept = decontamination.drop_contaminated(odd, items)
    assert by_id(kept.select("doc_id").collect()) == [(1,), (2,), (3,), (4,), (4,)] and kept.columns == odd.columns


def test_secrets(odd):
    rows = secrets.find_secrets(odd).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert by_id(rows, "n_assign", "base_sha256") == [(i, 0, none) for i in (None, 1, 2, 3, 4, 4, 5, 6, 7)]


def test_quality(odd):
    judged = quality_rules.judge(odd.drop("quality"))
    got = {r.doc_id: (r.quality.n_words, r.quality.n_repeat_words, r.quality.base_failed) for r in judged.collect()}
    assert got == {1: (0, 0, True), 2: (0, 0, True), 3: (0, 0, True), 4: (1, 0, True), None: (6, 0, True), 5: (30_000, 30_000, True), 6: (30_000, 30_000, True), 7: (6, 0, True)}


def test_classifier(odd):
    got = by_id(quality_classifier.classify(odd).collect(), "weak_label", "score", "kept")
    rows = {i: tuple(r) for i, *r in got}
    assert len(got) == 9 and rows[1] == rows[2] == rows[3] and rows[5] == rows[6] and got[4] == got[5]


def test_mix(odd):
    rows = mixing.mix_sources(odd).collect()
    got = {r.id: (r["size"], r.taken) for r in rows if r.id in (1, 2, 3)}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0)} and len(rows) == 9
    # the source s has two words, and its target is twice that: the equal rows are taken twice each
    assert [(r["size"], r.taken) for r in rows if r.id == 4] == [(1, 2), (1, 2)]
    assert sum(r.taken for r in rows) == round(sum({(r.source_size, r.target): r.target for r in rows}.values()))


def test_language(odd):
    rows = language_id.predict(odd, language_id.train(odd), [F.col("doc_id")]).collect()
    got = by_id(rows, "lang_pred", "score")
    assert all((p == "und") == (i in (1, 2, 3)) and (s == 0) == (p == "und") for i, p, s in got) and got[6][1:] == got[7][1:]


def test_files(odd, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_files.token_files(odd, path, 1, f"file://{tmp_path}/files").orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    want = sorted(((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x))
    assert [(r.doc_id, r.n_tokens) for r in rows] == want


def test_counts(odd):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in token_counts.rollup(token_counts.inserts(token_counts.counted(odd))).where("tokenizer = 'words-1'").collect()}
    assert got == {(None, None): (1, 0), ("s", "en"): (2, 0), ("s", None): (2, 2), ("t", "de"): (2, 30_006), (None, "de"): (1, 30_000), ("t", "en"): (1, 6)}
