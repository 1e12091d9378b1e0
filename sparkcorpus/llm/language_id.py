"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of letters (lower case, other characters as one blank), hashed. Document frequencies are
counted over all training documents. The weights are learned by follow-the-regularised-leader with elastic-net
penalties (L1 makes them sparse, L2 small), on a sample of PER_LANGUAGE training documents of each language at most, each
as likely as any other, of which equal texts are one item with their number as weight; a fifth of the sample is kept out
of the fit and sets the temperature that calibrates the scores.

The sample is the only bound, and only the fit uses it: counting and predicting cover whole texts of all rows. The model
has 2**BITS rows of one number for each language, whatever the input, and is what is broadcast.

Edge cases: a null text, or one without a letter, is `und` with score 0. A very long text is read whole, in memory of some
20 times its size. Ties between languages go to the first in code point order. Without training rows every text is `und`. Repeated rows count as often as they occur. Labels of null are
not learned from. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, repeats, sampled, slices

BITS = 16
#: Training documents of each language that the fit uses at most.
PER_LANGUAGE = 800
#: A model of so many languages is 64 MB; a column with more values isn't one of languages.
MOST_LANGUAGES = 256
SCALE = 30.0

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def ngrams(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(features, text of each): the hashed 1- to 3-grams of all texts at once."""
    low = [(t or "").lower() for t in texts]
    size = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    # a blank before and after each text keeps n-grams from running into another one
    code = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters()[code], code, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    one, shift = code * np.uint32(0x9E3779B1), np.uint32(32 - bits)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + code[2:]
    spread = lambda x: ((x ^ (x >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> shift
    own = code != 32
    near = own[:-1] | own[1:]
    return np.concatenate([spread(one)[own], spread(two)[near], spread(three)[own[1:-1]]]), np.concatenate([row[own], row[:-1][near], row[1:-1][own[1:-1]]])


def document_frequencies(texts: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and their number, over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << bits, np.int64), 0
        for part in slices(batches, "text", 1 << 20):
            feature, row = ngrams(part.column("text").to_pylist(), bits)
            n += part.num_rows
            seen += np.bincount(np.unique((row.astype(np.int64) << bits) | feature) & ((1 << bits) - 1), minlength=1 << bits)
        at = np.flatnonzero(seen)
        yield pa.record_batch({"f": pa.array([-1, *at], pa.int64()), "n": pa.array([n, *seen[at]], pa.int64())})

    counted = texts.select("text").mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = counted.column("f").to_numpy(), counted.column("n").to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, dims: int, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3, batch: int = 16, seed: int = 0) -> np.ndarray:
    """Weights (dims, classes) by FTRL-proximal over mini-batches of sparse rows (features, values)."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            at, local = np.unique(np.concatenate([rows[i][0] for i in pick]), return_inverse=True)
            x = np.zeros((len(pick), len(at)))
            x[np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick]), local] = np.concatenate([rows[i][1] for i in pick])
            w = weights(at)
            p = softmax(x @ w)
            p[np.arange(len(pick)), label[pick]] -= 1
            g = x.T @ p / len(pick)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dims))


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the logits that makes the labels most likely, by search on a grid of powers."""
    if not len(label):
        return 1.0
    grid = 2.0 ** np.linspace(-6, 6, 97)
    return float(min(grid, key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean()))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, bits: int = BITS,
    id_col: str | None = None) -> dict | None:
    """Model from the rows of docs with a language, all of which are training rows.

    Refuses over MOST_LANGUAGES languages: counts, model and broadcast have a place for each of them.
    """
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
        (F.lit(0) if id_col is None else F.col(f"`{id_col}`")).alias("id"))
    counts = {r.lang: r.texts for r in rows.groupBy("lang").agg(F.count("text").alias("texts")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return None
    langs = sorted(counts)
    frequency, n = document_frequencies(rows, bits)
    idf = np.log((1 + n) / (1 + frequency)) + 0.1
    share = F.element_at(F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_language / max(counts[k], 1))))), F.col("lang"))
    sample = sampled(rows, share, per_language, "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            feature, row = ngrams(part.column("text").to_pylist(), bits)
            pair, count = np.unique((row.astype(np.int64) << bits) | feature, return_counts=True)
            ends = np.searchsorted(pair, np.arange(part.num_rows + 1) << bits)
            yield pa.record_batch({"lang": part.column("lang"), "f": pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                pa.array(pair & ((1 << bits) - 1), pa.int32())), "n": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(count,
                pa.int32())), "copies": part.column("copies")})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, label, copies = [], [], []
        for b in batches:
            for lang, f, c, k in zip(b.column("lang").to_pylist(), b.column("f"), b.column("n"), b.column("copies").to_pylist(), strict=True):
                f, c = f.values.to_numpy(), c.values.to_numpy()
                if len(f):
                    data.append((f, SCALE * idf[f] * c / c.sum()))
                    label.append(langs.index(lang))
                    copies.append(k)
        label = np.array(label, np.int64)
        order = sorted(range(len(data)), key=lambda i: (label[i], len(data[i][0]), data[i][0].tobytes(), data[i][1].tobytes()))  # a retry gives the same
        copies = np.array(copies, np.int64)
        if len(order):
            parts = [np.array([i for i in order if label[i] == k], np.int64) for k in range(len(langs))]
            order = np.concatenate([p[repeats(copies[p], per_language)] for p in parts])
        data, label = [data[i] for i in order], label[order]
        held = np.arange(len(data)) % 5 == 4
        w = ftrl([data[i] for i in np.flatnonzero(~held)], label[~held], len(langs), 1 << bits)
        logits = np.array([data[i][1] @ w[data[i][0]] for i in np.flatnonzero(held)]).reshape(-1, len(langs))
        out = io.BytesIO()
        np.savez(out, w=w.astype(np.float32), t=temperature(logits, label[held]))
        yield pa.record_batch({"model": pa.array([out.getvalue()], pa.binary())})

    kept = materialize(sample.mapInArrow(features, "lang string, f array<int>, n array<int>, copies long"))  # bounded by per_language
    model = np.load(io.BytesIO(bytes(kept.coalesce(1).mapInArrow(fit, "model binary").first()[0])))
    return {"langs": langs, "weights": (SCALE * idf[:, None] * model["w"]).astype(np.float32), "temperature": float(model["t"]), "bits": bits}


def predict(docs: DataFrame, model: dict | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score, for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    (text,) = fresh(kept, "text")
    rows = docs.select(*keep, F.col(f"`{text_col}`").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, text, 1 << 20):
            n = part.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            if m is not None:
                feature, row = ngrams(part.column(text).to_pylist(), m["bits"])
                total = np.bincount(row, minlength=n)
                logits = np.stack([np.bincount(row, m["weights"][feature, k], minlength=n) for k in range(len(m["langs"]))],
                    axis=1) / np.maximum(total, 1)[:, None]
                p = softmax(logits / m["temperature"])
                has = total > 0
                lang[has], score[has] = np.array(m["langs"], object)[p.argmax(axis=1)][has], p.max(axis=1)[has]
            columns = {c: part.column(c) for c in part.schema.names if c != text}
            yield pa.record_batch(columns | {"lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
