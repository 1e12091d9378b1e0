import hashlib
import math
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcorpus.llm import near_dedup, quality_rules

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import plain_targets  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    source = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in seen["quality_rules"]} == {r.doc_id for r in quality_rules.judge(source).where("quality.kept").collect()}
    assert len(seen["near_dedup"]) == len({near_dedup.text_fingerprint(r.text) for r in seen["quality_rules"]}) or len(seen["near_dedup"]) < len(seen["quality_rules"])
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(t.lower().split())
    left = {r.doc_id for r in seen["decontamination"]}
    assert all((r.doc_id not in left) == any(flat(p) in flat(r.text) for p in passages) for r in seen["near_dedup"])
    assert {r.doc_id for r in seen["mixing"]} <= left and [r.doc_id for r in sorted(seen["token_files"], key=lambda r: r.start)] == sorted(r.doc_id for r in seen["mixing"])
    assert sum(r.n_tokens for r in seen["token_files"]) == max(r.start + r.n_tokens for r in seen["token_files"])


def test_run_is_the_stages(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and a


# --- the whole by brute force ------------------------------------------------------------------------------------


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def plain_good(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = len({i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)})
    stop = {x for s in quality_rules.STOP_WORDS.split() for x in (s, s.capitalize())}
    if len(w) < 50 or repeated > 0.5 * len(w):
        return False
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    stops = sum(x in stop for x in w) / len(w)
    return 2 <= chars / len(w) <= 16 and symbols / len(w) <= 0.25 and stops >= 0.02 and (len(lines) - len(set(lines))) / len(lines) <= 0.5 and upper / chars <= 0.5


def shingles(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def plain_groups(rows):
    """The row of the smallest id of each group that pairs of similarity 0.8 or more make."""
    sets, root = [set(shingles(t)) for _, t in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [rows[i] for i in range(len(rows)) if root[i] == i]


def plain_leak(text, items):
    w, own = text.lower().split(), set(shingles(text))
    for item in items:
        v = item.lower().split()
        want = Counter(tuple(v[i : i + 5]) for i in range(len(v) - 4))
        if len(v) < 5 or not own & set(want):
            continue
        for s in range(max(1, len(w) - len(v) + 1)):
            have = Counter(tuple(w[i : i + 5]) for i in range(s, min(s + len(v), len(w)) - 4))
            if 2 * sum((have & want).values()) >= 0.8 * (sum(have.values()) + sum(want.values())):
                return True
    return False


def plain_mix(rows, weight):
    """Rows as often as they are taken: (id, text, source) in, with a weight by id."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(words(text))
    targets, out = plain_targets(dict(size)), []
    for source, target in targets.items():
        budget, before = round(target), 0
        epochs = budget // size[source]
        key = lambda r: (-math.log((int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / weight.get(r[0], 1.0), r[0])
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=key):
            n = len(words(text))
            taken = epochs * n + max(0, min(n, budget - epochs * size[source] - before))
            out += [(i, text)] * math.floor(taken / n + 0.5)
            before += n
    return out


def test_run_against_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    docs = sorted((r.doc_id, r.text, r.source) for r in read("documents") if plain_good(r.text))
    source = {i: s for i, _, s in docs}
    kept = plain_groups([(i, t) for i, t, _ in docs])
    items = [r.text for r in read("benchmark")]
    clean = [(i, t, source[i]) for i, t in kept if not plain_leak(t, items)]
    votes = defaultdict(list)
    for r in read("labels"):
        if r.quality is not None:
            votes[r.doc_id].append(r.quality)
    mixed = sorted(plain_mix(clean, {i: 2.0 if sum(v) / len(v) >= 0.5 else 0.5 for i, v in votes.items()}))
    tokenizer, start, wanted = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in mixed:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert len(kept) < len(docs) and len(clean) < len(kept)
    assert got == sorted(wanted)


CLASH = ("id", "h", "of", "at", "own", "row", "bad", "copies", "rows", "each", "again", "size", "weight", "word", "key", "fp", "n", "count", "quality", "bucket", "root")


def odd_documents(spark):
    good = " ".join(f"the{i} and of word{i}" for i in range(40))
    long = " ".join(f"the of long{i % 9001}" for i in range(40_000))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, good + " more", "en", "s", 1), (None, good.replace("the", "THE"), None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, long, "de", None, 9), (1, long[: len(long) // 2], "de", "t", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def test_stages_on_odd_documents(spark):
    df = odd_documents(spark)
    empty = df.limit(0)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, SF), stage(spark, empty, SF)
        if name != "token_files":
            assert out.columns == df.columns and none.columns == df.columns
        counts[name] = Counter((r.doc_id, len(r.text or "") if "text" in out.columns else r.n_tokens) for r in out.collect())
        assert none.count() == 0
    near = counts["near_dedup"]
    # the halves of the long text have the same shingles; null and empty texts are copies of each other
    assert sum(near.values()) == 3 and {k[0] for k in near} == {1, 3} and counts["decontamination"] == Counter((r.doc_id, len(r.text or "")) for r in df.collect())
    assert sum(counts["token_files"].values()) == df.count() and set(counts["mixing"]) <= set(counts["decontamination"])
