"""The trained operators against plain versions of their whole computation, from texts to scores, on 200 rows.

The plain versions go letter by letter and weight by weight; only the order of the rows and the random permutation are taken
from the same definitions.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkcorpus.llm import language_id, quality_classifier
from sparkcorpus.llm.quality_rules import STOP_WORDS

SF = "/root/testdata/sf0.001"
M = 0xFFFFFFFF


def rows_of(spark, columns):
    table = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").select("doc_id", *columns)
    extra = [(-1, *[None] * len(columns)), (-2, "12 34 !", *[None] * (len(columns) - 1))]
    return table.union(spark.createDataFrame(extra, table.schema))


# --- language ----------------------------------------------------------------------------------------------------


def plain_ngrams(text, bits):
    code = [ord(c) if c.isalpha() else 32 for c in f" {(text or '').lower()} "]
    own = [c != 32 for c in code]
    last = lambda x: ((((x ^ x >> 16) & M) * 0x27D4EB2F) & M) >> (32 - bits)
    one = [c * 0x9E3779B1 & M for c in code]
    two = [((one[i] ^ one[i] >> 15) * 0x85EBCA77 + code[i + 1]) & M for i in range(len(code) - 1)]
    three = [((two[i] ^ two[i] >> 13) * 0xC2B2AE3D + code[i + 2]) & M for i in range(len(code) - 2)]
    out = [last(x) for x, o in zip(one, own, strict=True) if o]
    out += [last(x) for i, x in enumerate(two) if own[i] or own[i + 1]]
    return out + [last(x) for i, x in enumerate(three) if own[i + 1]]


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_ftrl(data, label, classes, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=3, batch=16):
    z, n = defaultdict(lambda: [0.0] * classes), defaultdict(lambda: [0.0] * classes)

    def weight(f, k):
        s = z[f][k]
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n[f][k])) / alpha + l2)

    random = np.random.default_rng(0)
    for _ in range(epochs):
        order = random.permutation(len(data)).tolist()
        for a in range(0, len(order), batch):
            pick, gradient, old = order[a : a + batch], defaultdict(lambda: [0.0] * classes), {}
            for i in pick:
                for f in data[i]:
                    old[f] = [weight(f, k) for k in range(classes)]
            for i in pick:
                p = plain_softmax([sum(x * old[f][k] for f, x in data[i].items()) for k in range(classes)])
                p[label[i]] -= 1
                for f, x in data[i].items():
                    for k in range(classes):
                        gradient[f][k] += x * p[k] / len(pick)
            for f, g in gradient.items():
                for k in range(classes):
                    sigma = (math.sqrt(n[f][k] + g[k] ** 2) - math.sqrt(n[f][k])) / alpha
                    z[f][k] += g[k] - sigma * old[f][k]
                    n[f][k] += g[k] ** 2
    return {f: [weight(f, k) for k in range(classes)] for f in z}


def test_language_scores_are_those_of_the_plain_model(spark):
    bits, scale = 12, language_id.SCALE
    table = rows_of(spark, ["text", "lang"])
    rows = [tuple(r) for r in table.collect()]
    training = [(t, g) for d, t, g in rows if g is not None and d % 3 != 0]
    model = language_id.train(table.where("doc_id % 3 <> 0"), bits=bits, id_col="doc_id")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(table, model, [F.col("doc_id")]).collect()}

    langs = sorted({g for _, g in training})
    frequency = Counter(f for t, _ in training for f in {*plain_ngrams(t, bits)})
    idf = lambda f: math.log((1 + len(training)) / (1 + frequency[f])) + 0.1
    data = []
    for (text, lang), copies in Counter((t, g) for t, g in training if t is not None).items():
        c = Counter(plain_ngrams(text, bits))
        if c:
            f = sorted(c)
            x = [scale * idf(i) * c[i] / c.total() for i in f]
            data.append((langs.index(lang), len(f), np.array(f, np.int32).tobytes(), np.array(x).tobytes(), dict(zip(f, x, strict=True)), copies))
    data.sort(key=lambda r: r[:4])
    items = [r for r in data for _ in range(r[5])]
    held = [i for i in range(len(items)) if i % 5 == 4]
    fit = [r for i, r in enumerate(items) if i % 5 != 4]
    w = plain_ftrl([r[4] for r in fit], [r[0] for r in fit], len(langs))
    logits = [[sum(x * w.get(f, [0.0] * len(langs))[k] for f, x in items[i][4].items()) for k in range(len(langs))] for i in held]
    loss = lambda t: -sum(math.log(max(plain_softmax([v / t for v in x])[items[i][0]], 1e-12)) for x, i in zip(logits, held, strict=True)) / len(held)
    best = min((2.0 ** (-6 + k / 8) for k in range(97)), key=loss)
    assert abs(best - model["temperature"]) < 1e-9
    for d, text, _ in rows:
        c = Counter(plain_ngrams(text, bits))
        if not c:
            assert got[d] == ("und", 0.0)
            continue
        x = [sum(n * scale * idf(f) * w.get(f, [0.0] * len(langs))[k] for f, n in c.items()) / c.total() for k in range(len(langs))]
        p = plain_softmax([v / best for v in x])
        assert got[d][0] == langs[p.index(max(p))] and abs(got[d][1] - max(p)) < 1e-3


# --- quality -----------------------------------------------------------------------------------------------------

SPACE, STOP = re.compile(r"[\x20\x09-\x0D]+"), {x for w in STOP_WORDS.split() for x in (w, w.capitalize())}


def plain_metrics(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    chars, per = sum(map(len, words)), lambda x, n: x / n if n else 0.0
    return {"n_words": len(words), "mean_word_chars": per(chars, len(words)), "symbol_word_ratio": per(sum(c in "#*$%&|<>" for c in text), len(words)),
        "stop_word_ratio": per(sum(w in STOP for w in words), len(words)), "dup_line_ratio": per(len(lines) - len(set(lines)), len(lines)),
        "repeat_word_ratio": per(len(again), len(words)), "upper_ratio": per(sum(unicodedata.category(c) == "Lu" for c in text), chars)}


def plain_vote(labeller, m):
    x = m[labeller.metric]
    if m["n_words"] < labeller.from_words or x is None:
        return 0
    if labeller.bad_below is not None and x < labeller.bad_below or labeller.bad_above is not None and x > labeller.bad_above:
        return -1
    if labeller.good_from is None and labeller.good_to is None:
        return 0
    return int((labeller.good_from is None or x >= labeller.good_from) and (labeller.good_to is None or x <= labeller.good_to))


def plain_posteriors(votes):
    """Posterior of good for each pattern, document by document."""
    patterns, n = Counter(votes), len(votes[0])
    post, prior = {v: 0.1 if -1 in v else 0.9 for v in patterns}, 0.8
    for _ in range(200):
        mass = [sum(c * (1 - post[v]) for v, c in patterns.items()), sum(c * post[v] for v, c in patterns.items())]
        chance = {}
        for k in (0, 1):
            for i in range(n):
                seen = {s: 1 / 3 + sum(c * (post[v] if k else 1 - post[v]) for v, c in patterns.items() if v[i] == s) for s in (-1, 0, 1)}
                for s in seen:
                    chance[k, i, s] = seen[s] / sum(seen.values())
        prior = min(max(mass[1] / max(sum(mass), 1), 0.02), 0.98)
        new = {}
        for v in patterns:
            bad, good = (sum(math.log(chance[k, i, v[i]]) for i in range(n)) + math.log(prior if k else 1 - prior) for k in (0, 1))
            new[v] = 1 / (1 + math.exp(min(max(bad - good, -50), 50)))
        moved, post = max(abs(new[v] - post[v]) for v in patterns), new
        if moved < 1e-9:
            break
    return post


def plain_features(text, bits):
    words = [w for w in SPACE.split(text or "") if w]
    h = lambda x, seed: xxhash.xxh64_intdigest(x.encode(), seed) >> (64 - bits)
    kind = lambda c: 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if ord(c) > 127 else 0

    def form(word):
        out = "\x00"
        for k, run in groupby(word, kind):
            run = "".join(run)
            case = "a" if run[0].islower() else "A" if run[0].isupper() else "0" if run[0].isdigit() else "u"
            out += run if k == 0 else case
        return out

    again = sum(w in words[max(0, i - 3) : i] for i, w in enumerate(words))
    return Counter([h(w, 0) for w in words] + [h(form(w), 1) for w in words] + [0] * again)


def plain_logistic(data, target, epochs=6, batch=32, rate=1.0, l2=1e-4):
    w, seen, b, seen_b, random = defaultdict(float), defaultdict(lambda: 1e-6), 0.0, 1e-6, np.random.default_rng(0)
    for _ in range(epochs):
        order = random.permutation(len(data)).tolist()
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            error = {i: 1 / (1 + math.exp(-(sum(x * w[f] for f, x in data[i].items()) + b))) - target[i] for i in pick}
            g = defaultdict(float)
            for i in pick:
                for f, x in data[i].items():
                    g[f] += x * error[i]
            step = {f: g[f] / len(pick) + l2 * w[f] for f in g}
            for f, s in step.items():
                seen[f] += s * s
                w[f] -= rate * s / math.sqrt(seen[f])
            mean = sum(error[i] for i in pick) / len(pick)
            seen_b += mean**2
            b -= rate * mean / math.sqrt(seen_b)
    return w, b


def test_quality_scores_are_those_of_the_plain_model(spark):
    bits, labellers = 12, quality_classifier.LABELLERS
    table = rows_of(spark, ["text"])
    rows = [tuple(r) for r in table.collect()]
    got = {r.id: r for r in quality_classifier.classify(table, bits=bits).collect()}
    votes = {d: tuple(plain_vote(x, plain_metrics(t)) for x in labellers) for d, t in rows}
    post = plain_posteriors([*votes.values()])
    for d, _ in rows:
        assert abs(got[d].weak_label - post[votes[d]]) < 1e-6
    data = []
    for text, copies in Counter(t for _, t in rows if t is not None).items():
        c = plain_features(text, bits)
        f = sorted(c)
        p = post[votes[next(d for d, t in rows if t == text)]]
        n = np.array([c[i] for i in f], np.int32)
        data.append((p, len(f), np.array(f, np.int32).tobytes(), n.tobytes(), {i: 2.0 * c[i] / max(c.total(), 1) for i in f}, copies))
    weak = {r.weak_label for r in got.values()}
    # rows are ordered by their label; the operator's own digits decide between labels that are equal but for rounding
    data = [(min(weak, key=lambda x: abs(x - r[0])), *r[1:]) for r in data]
    data.sort(key=lambda r: r[:4])
    items = [r for r in data for _ in range(r[5])]
    w, b = plain_logistic([r[4] for r in items], [r[0] for r in items])
    for d, text in rows:
        c = plain_features(text, bits)
        x = sum(n * w[f] for f, n in c.items()) / max(c.total(), 1) * 2.0 + b
        assert abs(got[d].score - 1 / (1 + math.exp(-x))) < 1e-3 and got[d].kept == (got[d].score >= 0.5)
