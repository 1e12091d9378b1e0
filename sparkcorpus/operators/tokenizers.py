"""Subword tokenizers with offsets in code points, for chunks and budgets: files of the tokenizers, tiktoken and
sentencepiece libraries.

A file is loaded once in each Python process, and its SHA-256 can be pinned. Texts are encoded in slices of SLICE_CHARS, many at
a time. Libraries that count in bytes, or give no offsets, are asked for ids only: a token's bytes follow from its id, where
it ends from their number, and the code point from the number of leading bytes before. A token that ends inside a character
spans it whole, as its neighbour does. No special tokens, no truncation; tokens without width are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text that is encoded at once, in characters.
SLICE_CHARS = 1 << 20
Spans = tuple[np.ndarray, np.ndarray]
_loaded: dict[tuple[str, str | None, str | None], Callable[[list[str]], list[Spans]]] = {}


class TokenizerFileError(ValueError):
    """The file isn't there, isn't the pinned one, or is of no known kind."""


def spans_of_bytes(sizes: np.ndarray, text: bytes, before: int = 0) -> Spans:
    """Starts and ends in code points of tokens of these sizes in bytes, the first of which begin `before` bytes before the text."""
    count = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # characters that begin before a byte
    end = np.cumsum(sizes, dtype=np.int64) - before
    start = np.maximum(end - sizes, 0)
    some = end > start
    start, end = start[some], end[some]
    return count[start + 1] - 1, count[end]


def _tokenizers_file(path: str) -> Callable[[list[str]], list[Spans]]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def run(texts: list[str]) -> list[Spans]:
        out = []
        for found in own.encode_batch(texts, add_special_tokens=False):
            spans = np.array(found.offsets, np.int64).reshape(-1, 2)
            spans = spans[spans[:, 1] > spans[:, 0]]
            out.append((spans[:, 0], spans[:, 1]))
        return out

    return run


def _tiktoken_file(path: str, pattern: str | None) -> Callable[[list[str]], list[Spans]]:
    import tiktoken

    if pattern is None:
        raise TokenizerFileError("a tiktoken file needs the pattern that splits a text")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return lambda texts: [spans_of_bytes(sizes[np.array(own.encode_ordinary(t), np.int64)], t.encode()) for t in texts]


def _sentencepiece_file(path: str) -> Callable[[list[str]], list[Spans]]:
    from sentencepiece import SentencePieceProcessor

    own, byte = SentencePieceProcessor(model_file=path), re.compile(r"<0x([0-9A-F]{2})>")
    pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    parts = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(t)) else t.replace("▁", " ").encode() for t in pieces]
    sizes = np.array([len(p) for p in parts], np.int64)

    def run(texts: list[str]) -> list[Spans]:
        out = []
        for text, ids in zip(texts, own.encode(texts, num_threads=1), strict=True):
            body = text.encode()
            if b"".join(map(parts.__getitem__, ids)) == b" " + body:
                out.append(spans_of_bytes(sizes[np.array(ids, np.int64)], body, before=1))
            else:  # the library changed the text: it knows from which bytes tokens are
                found = [(p.begin, p.end) for p in own.encode(text, return_type="proto").pieces if p.end > p.begin]
                spans = np.array(found, np.int64).reshape(-1, 2)
                count = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
                out.append((count[spans[:, 0] + 1] - 1, count[spans[:, 1]]))
        return out

    return run


class FileTokenizer:
    """A tokenizer file: *.json (tokenizers), *.tiktoken or *.model (sentencepiece). It's loaded where it's used."""

    def __init__(self, path: str, sha256: str | None = None, pattern: str | None = None) -> None:
        self.path, self.sha256, self.pattern = path, sha256, pattern

    def _run(self) -> Callable[[list[str]], list[Spans]]:
        key = (self.path, self.sha256, self.pattern)
        if key not in _loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
            if not os.path.isfile(self.path):
                raise TokenizerFileError(f"no file {self.path}")
            if self.sha256 is not None:
                with open(self.path, "rb") as file:
                    if hashlib.file_digest(file, "sha256").hexdigest() != self.sha256:
                        raise TokenizerFileError(f"{self.path} isn't the pinned file")
            kinds = {".json": _tokenizers_file, ".tiktoken": lambda p: _tiktoken_file(p, self.pattern), ".model": _sentencepiece_file}
            kind = kinds.get(os.path.splitext(self.path)[1])
            if kind is None:
                raise TokenizerFileError(f"{self.path} is of no known kind")
            _loaded[key] = kind(self.path)
        return _loaded[key]

    def batch(self, texts: list[str]) -> Iterator[Spans]:
        """Starts and ends of the tokens of each text."""
        run, a, size = self._run(), 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SLICE_CHARS or i == len(texts) - 1:
                yield from run(texts[a : i + 1])
                a, size = i + 1, 0

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        start, end = self._run()([text])[0]
        return start.tolist(), end.tolist()

    @property
    def identity(self) -> str:
        """What goes into fingerprints: the SHA-256 of the file."""
        with open(self.path, "rb") as file:
            return f"{os.path.basename(self.path)}:{hashlib.file_digest(file, 'sha256').hexdigest()}"


def spans_of(tokenizer: Callable[[str], tuple[list[int], list[int]]], texts: list[str]) -> Iterator[Spans]:
    """Spans of each text, in batches where the tokenizer has them."""
    return tokenizer.batch(texts) if isinstance(tokenizer, FileTokenizer) else map(tokenizer, texts)


def count_tokens(rows: DataFrame, tokenizer: Callable[[str], tuple[list[int], list[int]]], text_col: str = "text", name: str = "tokens") -> DataFrame:
    """Adds the number of tokens of a text, with the tokenizer that chunks are measured with; null text has none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            counts = [len(start) for start, _ in spans_of(tokenizer, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, name])

    return rows.select(*(F.col(f"`{c}`") for c in rows.columns)).mapInArrow(run, f"{schema}, `{name}` long")
