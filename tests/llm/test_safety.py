"""Broken attempts, odd names, other tokenizers, dense texts: what must not give wrong results."""

import random
import threading
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcorpus.llm import common, decontamination, line_dedup, mixing, secrets, token_counts, token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")


# --- token counts ------------------------------------------------------------------------------------------------


def signed(spark, n):
    return spark.createDataFrame([("s", "en", "v", n, 1)], "source string, lang string, tokenizer string, tokens long, sign long")


def tokens(ledger):
    return sum(r.tokens for r in ledger.totals().collect())


@pytest.mark.parametrize("batch", ["2026/11", "..", "", "a b%/é", "x" * 500])
def test_odd_batch_ids(spark, tmp_path, batch):
    ledger = token_counts.Ledger(spark, str(tmp_path))
    assert ledger.commit("other", signed(spark, 1)) and ledger.commit(batch, signed(spark, 10)) and not ledger.commit(batch, signed(spark, 10))
    assert tokens(ledger) == 11 and ledger.committed(batch) and not ledger.committed("none")


def test_two_committers_of_one_batch(spark, tmp_path, monkeypatch):
    ledgers, barrier, out = [token_counts.Ledger(spark, str(tmp_path)) for _ in range(2)], threading.Barrier(2), []
    publish = token_counts.Ledger._publish

    def together(self, *args):
        barrier.wait()
        return publish(self, *args)

    monkeypatch.setattr(token_counts.Ledger, "_publish", together)
    work = [threading.Thread(target=lambda x=x: out.append(x.commit("b", signed(spark, 5)))) for x in ledgers]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(out) == [False, True] and tokens(ledgers[0]) == 5


def test_compaction(spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path))
    for i in range(4):
        ledger.commit(f"b{i}", signed(spark, i))
    ledger.commit("gone", spark.createDataFrame([("z", "en", "v", 3, 1), ("z", "en", "v", 3, -1)], signed(spark, 0).schema))
    signed(spark, 100).write.parquet(f"{tmp_path}/attempt/dead")
    ledger.compact()
    assert tokens(ledger) == 6 and {r.source for r in ledger.totals().collect()} == {"s"} and ledger._names("delta") == []
    assert not ledger.commit("b2", signed(spark, 2)) and ledger.commit("b5", signed(spark, 5)) and tokens(ledger) == 11
    signed(spark, 1).limit(0).write.parquet(f"{tmp_path}/attempt/dead2")
    ledger.compact()
    assert tokens(ledger) == 11 and ledger._names("snapshot") == ["0000000002"] and not ledger.commit("b5", signed(spark, 5))


def test_a_compaction_that_dies_before_it_removes(spark, tmp_path, monkeypatch):
    ledger = token_counts.Ledger(spark, str(tmp_path))
    ledger.commit("a", signed(spark, 7))
    kept = spark.createDataFrame([("s", "en", "v", 1, 7, 1)], token_counts.Ledger.SCHEMA)
    kept.write.parquet(f"{tmp_path}/snapshot/0000000001/totals")
    spark.createDataFrame([(ledger._name("a"),)], "name string").write.parquet(f"{tmp_path}/snapshot/0000000001/batches")
    assert tokens(ledger) == 7


# --- token files -------------------------------------------------------------------------------------------------


def test_any_tokenizer(spark, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    texts = ["Hello  world\n\n", " lead", None, "", "été 123 <|endoftext|>x", "a\tb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = token_files.token_files(rows, BYTES, 7, f"file://{tmp_path}/files").collect()
    for r in found:
        ids = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 7]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(found) == len(texts) and not token_files.by_words(BYTES) and token_files.by_words(public_tokenizers.path("word_bpe_49k.json"))


def test_parts_are_bounded_by_text(spark):
    r = random.Random(2)
    rows = [(i, "x" * r.choice([0, 5, 50, 3000])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = token_files.part_bounds(docs, "doc_id", "text", 100_000)
    sizes = [0] * (len(bounds) + 1)
    for i, text in rows:
        sizes[sum(b <= i for b in bounds)] += len(text) + 8
    assert len(bounds) > 10 and max(sizes) <= 210_000
    assert token_files.part_bounds(docs.limit(0), "doc_id", "text") == []


# --- secrets -----------------------------------------------------------------------------------------------------

TOKEN = "Zx9Kq2Lm7Rt4Wp8Yb3Nc6"


def verdicts(spark, places):
    rows = spark.createDataFrame([(i, f"key {TOKEN} password={TOKEN}", o, p) for i, (o, p) in enumerate(places)], "doc_id long, text string, source string, repo string")
    found = secrets.find_secrets(rows, repo_col="repo").collect()
    return {(s.kind, s.verdict, s.n_owners, s.n_repos, s.n_copies) for r in found for s in r.spans}


def test_repositories_alone_change_the_verdict(spark):
    one = verdicts(spark, [("o", "r1"), ("o", "r2"), ("o", "r2")])
    assert one == {("owned", "live", 1, 2, 6), ("assign", "live", 1, 2, 6)}
    assert verdicts(spark, [("o", f"r{i}") for i in range(3)]) == {("assign", "shared", 1, 3, 6)}
    assert verdicts(spark, [("o", f"r{i}") for i in range(6)]) == {("assign", "example", 1, 6, 12)}
    assert verdicts(spark, [(f"o{i}", "r") for i in range(3)]) == {("assign", "example", 3, 3, 6)}


def test_values_that_look_regular_are_no_credentials(spark):
    rows = spark.createDataFrame([(0, "aaaaaaaaaaaaaaaaaaa1 " + TOKEN, "o")], "doc_id long, text string, source string")
    assert [(s.start, s.end) for s in secrets.find_secrets(rows).first().spans] == [(21, 21 + len(TOKEN))]


def test_apart():
    r = random.Random(0)
    for _ in range(200):
        base = sorted((a := r.randrange(50), a + r.randrange(1, 9)) for _ in range(r.randrange(8)))
        found = sorted((a := r.randrange(50), a + r.randrange(1, 9)) for _ in range(r.randrange(8)))
        assert secrets.apart(found, base) == [(a, z) for a, z in found if not any(x < z and a < y for x, y in base)]


def test_a_text_full_of_secrets(spark):
    r = random.Random(1)
    token = lambda: "".join(r.choice("abcdefghjkXYZ0123456789") for _ in range(24))
    text = " ".join(f"{token()} secret={token()}" for _ in range(18_000))
    assert len(text) > 10**6
    began = time.time()
    n = secrets.find_secrets(spark.createDataFrame([(0, text, "o")], "doc_id long, text string, source string")).first()
    assert n.n_assign == 18_000 and len(n.spans) > 30_000 and time.time() - began < 60


# --- decontamination ---------------------------------------------------------------------------------------------


def test_recall_just_above_the_threshold(spark):
    """Of pairs with a similarity from 0.8 to 0.85 at least 97 of 100 are found; the README says 99."""
    r = random.Random(8)
    items, texts = [], []
    for k in range(600):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 120))]
        changed = list(words)
        # each changed word breaks up to five shingles; the similarity is checked below
        for at in r.sample(range(2, len(words) - 2), max(1, round(len(words) * 0.035))):
            changed[at] = f"n{r.randrange(10**6)}"
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (words, changed))
        if 0.8 <= 2 * len(a & b) / (len(a) + len(b)) < 0.85:
            items.append((k, " ".join(words)))
            texts.append((k, " ".join(changed)))
    found = decontamination.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = {r.doc_id for r in found.where("doc_id = item_id").collect()}
    assert len(items) > 150 and len(hit) >= 0.97 * len(items)


def test_rows_of_one_id_are_judged_alone(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "clean text of its own kind"), (1, "before " + item), (None, "another clean text here now"), (None, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("bad", F.lit(2))
    kept = decontamination.drop_contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == ["another clean text here now", "clean text of its own kind"] and kept.columns == df.columns


# --- mixing ------------------------------------------------------------------------------------------------------


def test_a_heavy_weight_fills_many_buckets(spark):
    rows = spark.range(20_000).selectExpr("id", "id AS h", "'s' AS source", "10L AS size", "if(id % 3 = 0, 5000.0D, 0.001D) AS weight")
    taken = mixing.mix(rows, mixing.source_targets(rows, share=0.4), bucket_rows=100)
    keys = -F.log(common.uniform("id", seed="mix")) / F.col("weight")
    cells = rows.withColumn("cell", F.floor(F.log(keys) * mixing.CELLS)).groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] < 1000
    got = taken.agg(F.sum("taken").alias("t"), F.sum(F.when(F.col("id") % 3 == 0, F.col("taken"))).alias("heavy")).first()
    assert got.t == 80_000 and got.heavy > 66_000


def test_mixed_rows_of_one_id(spark):
    """Two texts of one id are taken on their own; equal rows share what falls on them."""
    rows = [(1, "a " * 40, "s"), (1, "b " * 10, "s"), (2, "c " * 30, "s"), (3, "d", "s"), (None, "e e", "s")] + [(9, "same text", "s")] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("x")).withColumn("h", F.lit("y"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = [r.text.split()[0] for r in out.collect()]
    assert all(1 <= got.count(w) <= 2 for w in "abcde") and 6 <= got.count("same") <= 12


# --- line dedup --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group_sets", [3, 256])
def test_lines_against_all_pairs(spark, group_sets):
    """Random lines of few words, many of them near copies, in an order of rarity from a small table."""
    r = random.Random(11)
    bases = [[f"w{r.randrange(40 if k % 3 else 4000)}" for _ in range(r.randrange(1, 60))] for k in range(40)]
    lines = []
    for _ in range(220):
        w = list(r.choice(bases))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"n{r.randrange(50)}"
        lines.append(" ".join(w))
    df = spark.createDataFrame([(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(74)], "doc_id long, text string")
    sets, wanted = [frozenset(x.split()) for x in lines], {}
    for k, own in enumerate(sets):
        like = [j for j, s in enumerate(sets) if own and s and len(own & s) >= 0.8 * len(own | s) - 1e-9]
        if like and like[0] < k:
            wanted[divmod(k, 3)] = (divmod(like[0], 3), len({sets[j] for j in like} - {own}))
    got = {(r.id, r.line): ((r.first_id, r.first_line), r.n_links) for r in line_dedup.matches(df, group_sets=group_sets).collect()}
    assert got == wanted and len(wanted) > 60


def test_a_group_of_near_copies_is_counted_not_listed(spark):
    """One line in 300 versions that differ from it in up to 9 words: many links need the words that two versions share."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    lines = [" ".join(base)]
    for _ in range(299):
        w = list(base)
        for _ in range(r.randrange(10)):
            w[r.randrange(12)] = f"n{r.randrange(30)}"
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sets, wanted = [frozenset(x.split()) for x in lines], {}
    for k, own in enumerate(sets):
        like = [j for j, s in enumerate(sets) if len(own & s) >= 0.8 * len(own | s) - 1e-9]
        if like[0] < k:
            wanted[k] = (like[0], len({sets[j] for j in like} - {own}))
    assert {r.id: (r.first_id, r.n_links) for r in line_dedup.matches(df, group_sets=16).collect()} == wanted
    every = line_dedup.sets(df, line_dedup.rarity(df))
    grouped = line_dedup.groups(every, 0.8, 16)
    listed = line_dedup.candidates(every.join(grouped, ["key", "sig"], "left")).count()
    assert grouped.select("key", "sig").distinct().count() > 250 and listed < 0.1 * 300 * 299 / 2
