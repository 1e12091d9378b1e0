"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on each document, from the statistics of the quality rules.
Expectation-maximisation estimates how often each labeller is right, without any labels: all that it needs is how often
each combination of votes occurs, which Spark counts over all documents; there are at most 3 ** labellers of them. The
posterior of a combination is the soft label of its documents, and trains a linear scorer on hashed words and word
shapes, which then scores every whole text.

Only the fit of the scorer uses a sample: SAMPLE rows with a text at most, each as likely as any other, of which equal
texts are one item with their number as weight. So its input is bounded and in proportion whatever the copies. Broadcast
are its 2**BITS weights.

Edge cases: a null text has no words: its votes are those of an empty text, its score the intercept's, and it is not in
the sample. A very long text is read whole, in the memory of its own size; it is one document like any other. If no
labeller ever votes, posteriors stay at the prior. Repeated rows count as often as they occur and get the same result; a
score of exactly `least` is good. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, materialize, repeats, sampled, slices, word_codes
from .quality_rules import let, statistics

BITS = 18
#: Documents that the fit of the scorer uses at most.
SAMPLE = 8_000
PRIOR = 0.8


@dataclass(frozen=True)
class Labeller:
    """Votes bad outside [bad_below, bad_above] of a metric, good inside [good_from, good_to]."""

    metric: str
    bad_below: float | None = None
    bad_above: float | None = None
    good_from: float | None = None
    good_to: float | None = None
    from_words: int = 0  # says nothing on shorter texts

    def vote(self, q: Column) -> Column:
        x, never = q[self.metric].cast("double"), F.lit(False)
        bad = (x < self.bad_below if self.bad_below is not None else never) | (x > self.bad_above if self.bad_above is not None else never)
        good = (x >= self.good_from if self.good_from is not None else F.lit(True)) & (x <= self.good_to if self.good_to is not None else F.lit(True))
        return F.when(q["n_words"] < self.from_words, 0).when(bad, -1).when(good if (self.good_from, self.good_to) != (None, None) else never, 1).otherwise(0)


LABELLERS = (
    Labeller("n_words", bad_below=4, good_from=80),
    Labeller("mean_word_chars", bad_below=2.5, bad_above=14, good_from=3, good_to=9),
    Labeller("symbol_word_ratio", bad_above=0.2, good_to=0.02),
    Labeller("stop_word_ratio", bad_below=0.03, good_from=0.12, from_words=20),
    Labeller("dup_line_ratio", bad_above=0.4, from_words=20),
    Labeller("repeat_word_ratio", bad_above=0.4, good_to=0.15, from_words=20),
    Labeller("upper_ratio", bad_above=0.4, good_to=0.1),
)


def votes_code(text: Column, labellers: Sequence[Labeller] = LABELLERS) -> Column:
    """The votes on a text as one number: digits of base 3, the first labeller's last."""
    votes = lambda q: F.array(*(x.vote(q) for x in labellers))
    return let(let(statistics(text), votes), lambda v: sum(((F.get(v, F.lit(i)) + 1) * 3**i for i in range(len(labellers))), F.lit(0)).cast("long"))


def votes_of(code: int, labellers: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(labellers))


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, prior: float = PRIOR, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(accuracy of each labeller where it votes, posterior of good for each row of votes, share of good).

    Rows are weighted by count. Given the class, a labeller votes bad, nothing or good with chances of its own, so one
    that votes good on nearly everything says little by it. The start is that a document with a bad vote is probably
    bad, which fixes which class is which; chances are smoothed by one document.
    """
    post = np.where((votes < 0).any(axis=1), 0.1, 0.9)
    said = np.stack([votes == v for v in (-1, 0, 1)], axis=-1).astype(float)  # row, labeller, vote
    for _ in range(rounds):
        mass = np.stack([count * (1 - post), count * post])  # class, row
        chance = np.einsum("cr,rlv->clv", mass, said) + 1 / 3
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float(np.clip(mass[1].sum() / max(mass.sum(), 1), 0.02, 0.98))
        log = np.einsum("rlv,clv->cr", said, np.log(chance)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            break
    mass = np.stack([count * (1 - post), count * post])
    right = np.einsum("r,rl->l", mass[0], said[:, :, 0]) + np.einsum("r,rl->l", mass[1], said[:, :, 2])
    return right / np.maximum(np.einsum("r,rl->l", count, said[:, :, 0] + said[:, :, 2]), 1e-12), post, prior


_RUN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^\x00-\x7f]+")


def shape(word: str) -> str:
    """Letters, capitals, digits and other scripts as one sign for each run; marks as they are."""
    return "\x00" + _RUN.sub(lambda m: "a" if m[0][0].islower() else "A" if m[0][0].isupper() else "0" if m[0][0].isdigit() else "u", word)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(features, text of each): hashed words and word shapes of all texts, and a mark for a word said just before."""
    codes, words, ends = word_codes(texts, lower=False)
    word = (hash_words(words) >> np.uint64(64 - bits)).astype(np.int64)
    form = (hash_words(pa.array([shape(w) for w in words.to_pylist()], pa.string()), 1) >> np.uint64(64 - bits)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    again = np.zeros(len(codes), bool)
    for back in (1, 2, 3):
        again[back:] |= (codes[back:] == codes[:-back]) & (row[back:] == row[:-back])
    return np.concatenate([word[codes], form[codes], np.zeros(again.sum(), np.int64)]), np.concatenate([row, row, row[again]])


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, bits: int = BITS, epochs: int = 6, batch: int = 32,
    rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by AdaGrad on the cross-entropy to soft targets; rows are sparse (features, values)."""
    w, seen, b, seen_b = np.zeros(1 << bits), np.full(1 << bits, 1e-6), 0.0, 1e-6
    random = np.random.default_rng(0)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            at = np.concatenate([rows[i][0] for i in pick])
            x, of = np.concatenate([rows[i][1] for i in pick]), np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            error = 1 / (1 + np.exp(-(np.bincount(of, x * w[at], len(pick)) + b))) - target[pick]
            own, local = np.unique(at, return_inverse=True)
            g = np.bincount(local, x * error[of]) / len(pick) + l2 * w[own]
            seen[own] += g * g
            w[own] -= rate * g / np.sqrt(seen[own])
            seen_b += (error.mean()) ** 2
            b -= rate * error.mean() / np.sqrt(seen_b)
    return w, float(b)


def train(rows: DataFrame, posterior: dict[int, float], n: int, sample: int = SAMPLE, bits: int = BITS,
    labellers: Sequence[Labeller] = LABELLERS) -> tuple[np.ndarray, float]:
    """Scorer from rows (id, text), of whose n texts `sample` are used at most. posterior: by the number of the votes."""
    picked = sampled(rows, F.lit(min(1.0, sample / max(n, 1))), sample).withColumn("votes", votes_code(F.col("text"), labellers))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            f, row = features(part.column("text"), bits)
            pair, count = np.unique((row << bits) | f, return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(part.num_rows + 1) << bits), pa.int32())
            own, count = pa.array(pair & ((1 << bits) - 1), pa.int32()), pa.array(count, pa.int32())
            p = pa.array([posterior[v] for v in part.column("votes").to_pylist()], pa.float64())
            lists = {"f": pa.ListArray.from_arrays(ends, own), "n": pa.ListArray.from_arrays(ends, count)}
            yield pa.record_batch({"p": p} | lists | {"copies": part.column("copies")})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = []
        for b in batches:
            columns = (b.column("p").to_pylist(), b.column("f"), b.column("n"), b.column("copies").to_pylist())
            data += [(p, f.values.to_numpy(), c.values.to_numpy(), k) for p, f, c, k in zip(*columns, strict=True)]
        data.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # a retry gives the same
        at = repeats(np.array([k for *_, k in data], np.int64), sample)
        scaled = [(f, 2.0 * c / max(c.sum(), 1)) for _, f, c, _ in data]
        w, b = logistic([scaled[i] for i in at], np.array([p for p, *_ in data])[at], bits)
        out = io.BytesIO()
        np.savez(out, w=w.astype(np.float32), b=b)
        yield pa.record_batch({"model": pa.array([out.getvalue()], pa.binary())})

    kept = materialize(picked.mapInArrow(encode, "p double, f array<int>, n array<int>, copies long"))  # bounded by the sample
    model = np.load(io.BytesIO(bytes(kept.coalesce(1).mapInArrow(fit, "model binary").first()[0])))
    return model["w"], float(model["b"])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labellers: Sequence[Labeller] = LABELLERS, sample: int = SAMPLE,
    bits: int = BITS, least: float = 0.5) -> DataFrame:
    """Rows (id, weak_label, score, kept), one for each row of docs: posterior of the votes, score of the text, and
    whether the document counts as good.

    The votes are kept between the two passes over the texts, a number for each id and text, and joined with the scores.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    votes = materialize(rows.select("id", F.xxhash64("text").alias("h"), F.col("text").isNotNull().alias("has"),
        votes_code(F.col("text"), labellers).alias("votes")))
    patterns = votes.groupBy("votes").agg(F.count("*").alias("count"), F.count_if("has").alias("texts")).collect()  # 3 ** labellers at most
    schema = f"id {rows.schema['id'].dataType.simpleString()}, weak_label double, score double, kept boolean"
    if not patterns:
        return docs.sparkSession.createDataFrame([], schema)
    patterns.sort()
    codes, count = [r.votes for r in patterns], np.array([r["count"] for r in patterns], float)
    _, post, _ = expectation_maximisation(np.array([votes_of(c, len(labellers)) for c in codes]), count)
    posterior = dict(zip(codes, post.tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, posterior, sum(r.texts for r in patterns), sample, bits, labellers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for part in slices(batches, "text"):
            f, row = features(part.column("text"), bits)
            n = part.num_rows
            x = np.bincount(row, w[f], n) / np.maximum(np.bincount(row, minlength=n), 1) * 2.0 + b
            yield pa.record_batch({"id": part.column("id"), "h": part.column("h"), "score": pa.array(1 / (1 + np.exp(-x)))})

    id_type = rows.schema["id"].dataType.simpleString()
    scored = rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, f"id {id_type}, h long, score double")
    own = votes.select(F.col("id").alias("of"), F.col("h").alias("at"), "votes").distinct()
    weak = F.element_at(F.create_map(*(F.lit(x) for kv in posterior.items() for x in kv)), F.col("votes"))
    both = scored.join(own, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("at")))
    return both.select("id", weak.alias("weak_label"), "score", (F.col("score") >= least).alias("kept"))
