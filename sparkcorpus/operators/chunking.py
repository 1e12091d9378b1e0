"""Tokens with offsets, the three chunking strategies, and the character cap.

A tokenizer gives parallel arrays of token starts and ends in code points. Arrays live only inside the map stage that
makes chunks; they are never shuffled. The cap is a built-in expression; all strategies use a vectorised helper, one
document at a time, as with arrays of built-in functions a window would cost as much as its document.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, is_blank
from .tokenizers import spans_of

#: Fixed cap of a chunk, in characters.
CHARACTER_CAP = 32_000
CHUNK = "ordinal int, text string, start long, end long, token_start long, token_end long"
Offsets = tuple[list[int], list[int]]
Tokenizer = Callable[[str], Offsets]

_WORD = re.compile(r"\S+")
_PIECE = re.compile(r"[぀-ヿ㐀-鿿가-힯]|\w+|[^\w\s]")


def whitespace_tokens(text: str) -> Offsets:
    """Runs of non-space characters."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [a for a, _ in spans], [z for _, z in spans]


def word_tokens(text: str) -> Offsets:
    """Words, single punctuation marks, and single CJK characters."""
    spans = [m.span() for m in _PIECE.finditer(text)]
    return [a for a, _ in spans], [z for _, z in spans]


def token_offsets(docs: DataFrame, text_col: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """Adds token_starts and token_ends; the white-space tokenizer is the default. Null text has no tokens."""
    run, schema = tokenizer or whitespace_tokens, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [*spans_of(run, [t or "" for t in part.column(text_col).to_pylist()])]
                ends = pa.array(np.cumsum([0, *(len(s) for s, _ in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]).astype(np.int64))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "token_starts", "token_ends"])

    return docs.mapInArrow(offsets, f"{schema}, token_starts array<bigint>, token_ends array<bigint>")


def token_count(text: Column) -> Column:
    """Number of white-space tokens, without arrays of offsets."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"(?U){SPACE}+"), "")).cast("long")


def enforce_character_cap(chunks: DataFrame, order: str = "ordinal", cap: int = CHARACTER_CAP) -> DataFrame:
    """Chunks over the cap become slices of `cap` characters without token offsets; blank slices are dropped. Adds part."""
    over = F.length("text") > cap
    rows = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / F.lit(cap)) - 1, F.lit(0)).cast("int"))))
    start = F.col("start") + F.when(over, F.col("part") * cap).otherwise(0)
    text = F.when(over, F.substring("text", F.col("part") * cap + 1, F.lit(cap))).otherwise(F.col("text"))
    tokens = [F.when(~over, F.col(c)).alias(c) for c in ("token_start", "token_end")]
    cut = rows.select("document_id", order, "part", text.alias("text"), start.alias("start"), (start + F.length(text)).alias("end"), *tokens)
    return cut.where(~is_blank(F.col("text")))


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("chunk size must be positive and the overlap smaller than it")


#: Separators of the recursive strategy, coarse to fine: blank line, sentence end, newline, white space. Fixed values.
LEVELS = (
    re.compile(r"\n[^\S\n]*\n+"),
    re.compile(r"(?<=[.!?。！？])(?:[ \t]+|\n+|(?=\S))"),  # noqa: RUF001
    re.compile(r"\n+"),
    re.compile(r"\s+"),
)
BLANK_LINE = LEVELS[0]


def _pieces(text: str, start: int, end: int, separator: re.Pattern) -> Iterator[tuple[int, int]]:
    """Ranges between the separators in text[start:end] that aren't blank."""
    at = start
    for m in separator.finditer(text, start, end):
        if m.end() == at == m.start():
            continue
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:end].strip():
        yield at, end


def _token_range(piece: tuple[int, int], starts: list[int], ends: list[int]) -> tuple[int, int]:
    return bisect_right(ends, piece[0]), bisect_left(starts, piece[1])


def natural_ends(text: str, starts: list[int], ends: list[int], size: int) -> list[int]:
    """Token positions after which a chunk may well end, finest where it has to be."""
    out, work = set(), [(0, len(starts), 0)]
    while work:
        a, z, level = work.pop()
        if z - a <= size and ends[z - 1] - starts[a] <= CHARACTER_CAP:
            out.add(z)
        elif level == len(LEVELS):
            out.update(range(a + size, z, size), [z])
        else:
            ranges = [r for p in _pieces(text, starts[a], ends[z - 1], LEVELS[level]) if (r := _token_range(p, starts, ends))[1] > r[0]]
            work += [(a, z, level + 1)] if len(ranges) <= 1 else [(x, y, level + 1) for x, y in ranges]
    return sorted(out)


def recursive_windows(text: str, starts: list[int], ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Token ranges of the chunks: each ends at the last natural end in reach, unless that brings nothing new."""
    n, stops, a = len(starts), natural_ends(text, starts, ends, size) if starts else [], 0
    while n:
        far = min(a + size, n)
        while far > a + 1 and ends[far - 1] - starts[a] > CHARACTER_CAP:
            far -= 1
        k = bisect_right(stops, far) - 1
        end = stops[k] if k >= 0 and stops[k] > a else far
        if end <= a + overlap and far > end:
            end = far
        yield a, end
        if end >= n:
            return
        a = max(a + 1, end - overlap)


def paragraph_windows(text: str, starts: list[int], ends: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Token ranges of packed paragraphs; one that is too large is cut into windows back to back."""
    held: tuple[int, int] | None = None
    for piece in _pieces(text, 0, len(text), BLANK_LINE):
        a, z = _token_range(piece, starts, ends)
        if z <= a:
            continue
        if held and (z - held[0] > size or ends[z - 1] - starts[held[0]] > CHARACTER_CAP):
            yield held
            held = None
        if z - a > size or ends[z - 1] - starts[a] > CHARACTER_CAP:
            yield from ((x, min(x + size, z)) for x in range(a, z, size))
        else:
            held = (held[0] if held else a, z)
    if held:
        yield held


def _capped(text: str, a: int, z: int, tokens: tuple[int | None, int | None]) -> Iterator[tuple]:
    if z - a <= CHARACTER_CAP:
        yield text[a:z], a, z, *tokens
        return
    for x in range(a, z, CHARACTER_CAP):
        if (part := text[x : min(x + CHARACTER_CAP, z)]).strip():
            yield part, x, x + len(part), None, None


def _chunked(docs: DataFrame, windows: Callable[[str, list[int], list[int]], Iterator[tuple[int, int]]], tokenizer: Tokenizer | None,
    id_col: str, text_col: str) -> DataFrame:
    run = tokenizer or whitespace_tokens

    def chunks_of(text: str, spans: tuple) -> Iterator[tuple]:
        starts, ends = (x.tolist() if isinstance(x, np.ndarray) else x for x in spans)
        if not starts:  # nothing to count, so the text itself is cut
            if text.strip():
                yield from _capped(text, 0, len(text), (None, None))
            return
        for a, z in windows(text, starts, ends):
            yield from _capped(text, starts[a], ends[z - 1], (a, z))

    def helper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 64):  # few documents at a time, as their chunks are held
                part = frame.iloc[i : i + 64]
                texts = [t or "" for t in part["text"]]
                found = zip(part["document_id"], texts, spans_of(run, texts), strict=True)
                rows = [(d, k, *c) for d, t, s in found for k, c in enumerate(chunks_of(t, s))]
                out = pd.DataFrame(rows, columns=["document_id", "ordinal", "text", "start", "end", "token_start", "token_end"])
                yield out.astype({"token_start": "Int64", "token_end": "Int64"})

    rows = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(helper, f"document_id {rows.schema['document_id'].dataType.simpleString()}, {CHUNK}")


def fixed_windows(n: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Token ranges of `size` tokens, each size - overlap after the last; the first that reaches the end is the last."""
    for a in range(0, n, size - overlap):
        yield a, min(a + size, n)
        if a + size >= n:
            return


def chunk_fixed(docs: DataFrame, size: int = 800, overlap: int = 100, tokenizer: Tokenizer | None = None, id_col: str = "document_id",
    text_col: str = "text") -> DataFrame:
    """Windows of `size` tokens with `overlap` tokens in common."""
    _check(size, overlap)
    return _chunked(docs, lambda t, s, e: fixed_windows(len(s), size, overlap), tokenizer, id_col, text_col)


def chunk_recursive(docs: DataFrame, size: int = 800, overlap: int = 100, tokenizer: Tokenizer | None = None, id_col: str = "document_id",
    text_col: str = "text") -> DataFrame:
    """Windows of at most `size` tokens that end at paragraphs, sentences or lines where they can."""
    _check(size, overlap)
    return _chunked(docs, lambda t, s, e: recursive_windows(t, s, e, size, overlap), tokenizer, id_col, text_col)


def chunk_paragraph(docs: DataFrame, size: int = 800, tokenizer: Tokenizer | None = None, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """Neighbouring paragraphs packed up to `size` tokens, without overlap."""
    _check(size, 0)
    return _chunked(docs, lambda t, s, e: paragraph_windows(t, s, e, size), tokenizer, id_col, text_col)
