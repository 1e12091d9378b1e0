"""Token ids of documents as flat binary files, and reading them back.

Format of a folder: for each part, `part-NNNNN.bin` holds the ids of its documents one after another as little-endian
unsigned integers (16 bits if the vocabulary allows, else 32), and `part-NNNNN.idx` holds the magic "IDX1", the width
of an id in bytes (uint32), the number of documents n (uint64), n + 1 offsets in ids (uint64, the first 0), and n
document ids (int64). Parts are in ascending order of document id; a reader maps the files into memory. The base of a
part, which is the number of ids in all parts before it, is the prefix sum of the parts' totals.

Tokenising is done where the texts are read, in the tokenizers library; the rows that are shuffled are ids, packed, and
not texts. A tokenizer that is known to give a text the ids of its words encodes each distinct word once per process; any
other one encodes whole texts. A part is a range of document ids with about PART_BYTES of text, at most twice as much; a
range with one id only isn't split. The bounds of the parts are the one list that tasks get, 8 bytes for each part. Files
get their name by a rename, and a second attempt puts the same file in the place of the first one.

Edge cases: a null text is an empty text: only the end id is written. A very long text is one record of its part, in
memory once. Rows with a null id come first, stored as the least 64-bit integer. Rows with equal ids follow one another,
ordered by their ids' bytes; equal rows give equal records. Other columns are not read. An empty table gives a folder
without parts and an empty result.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shared_folder, slices, word_codes

MAGIC = b"IDX1"
NO_ID = -(1 << 63)
#: Bytes of text in one part, about.
PART_BYTES = 64 << 20
#: Distinct words that a process remembers.
CACHE_WORDS = 1 << 18

_tokenizers: dict[str, object] = {}
_encoders: dict[str, WordEncoder | TextEncoder] = {}


def tokenizer_of(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: What the tokenizer splits a word at, for words of the plain kind below (lower-cased). Fixed pattern of the vocabulary.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: How a tokenizer of this kind describes itself: it drops white space and marks the ends of words. Fixed values.
WORD_KIND = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False},
}
#: Words that normalisation only lower-cases, and that hold no special token.
PLAIN = r"^[!-;=-~\x{A1}-\x{FF}]+$"
#: PARTS for words of this kind, where letters and numbers are these.
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF]+|[0-9\xB2\xB3\xB9\xBC-\xBE]|"
    r"[^\sa-z\xAA\xB5\xBA\xDF-\xF6\xF8-\xFF0-9\xB2\xB3\xB9\xBC-\xBE]+")


def by_words(path: str) -> bool:
    """Whether a text has the ids of its words one after another, by the tokenizer's own description."""
    kind = json.loads(tokenizer_of(path).to_str())
    same = all(kind[k] == WORD_KIND[k] for k in ("normalizer", "pre_tokenizer"))
    blanks = any(c.isspace() for t in kind["added_tokens"] for c in t["content"])
    return same and not blanks and WORD_KIND["model"].items() <= kind["model"].items()


class TextEncoder:
    """Encodes whole texts, with any tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = tokenizer_of(path)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after another, offsets by text)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + n], one after another."""
    total = np.cumsum(n)
    return flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first - (total - n), n)]


def joined(items: pa.Array) -> str:
    """The strings as one, with blanks between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items), " ")[0].as_py()


class Remembered:
    """Ids of strings, of which up to `most` are remembered."""

    def __init__(self, most: int) -> None:
        self.most, self.known = most, pa.array([], pa.string())
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, items: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first place and number of each item's ids in them). encode: ids of the new items one after another, and number
        of each; often: which items to remember."""
        where = pc.fill_null(pc.index_in(items, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        new, old = np.flatnonzero(where < 0), where >= 0
        new_flat, new_size = encode(items.take(pa.array(new)))
        size, first = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        size[old], first[old] = self.size[where[old]], self.first[where[old]]
        size[new], first[new] = new_size, len(self.flat) + np.cumsum(new_size) - new_size
        flat = np.concatenate([self.flat, new_flat])
        again = new[often[new]][: max(0, self.most - len(self.known))]
        if len(again):
            n = size[again]
            kept = gathered(flat, first[again], n)
            self.first, self.size = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n]), np.concatenate([self.size, n])
            self.flat = np.concatenate([self.flat, kept])
            self.known = pa.concat_arrays([self.known, items.take(pa.array(again))])
        return flat, first, size


class WordEncoder:
    """Encodes texts for a tokenizer that drops white space between words, so that a text has the ids of its words.

    The distinct words of a slice of texts are encoded once. Those seen more than once in it are remembered, up to
    cache_words; most words of a corpus are rare, and would only push out frequent ones.

    A plain word has the ids of its parts, which are fewer than words: rare words differ from others in a capital or a comma,
    too. Distinct parts are encoded once and remembered, up to cache_words. New ones are encoded many at a time, as one
    text; as the last id of a part is marked as a word's end, it's known where each ends. If a count doesn't agree, parts or
    words are encoded one by one, as are words that aren't plain.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer, self.known_words, self.known_parts = tokenizer_of(path), Remembered(cache_words), Remembered(cache_words)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flats, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 2048):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words[a : a + 2048].to_pylist(), add_special_tokens=False)]
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.concatenate(flats), np.concatenate(sizes)

    def _together(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flats, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(parts), 2048):
            own = parts[a : a + 2048]
            ids = np.array(self.tokenizer.encode_batch_fast([joined(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            ids, n = (ids, np.diff(ends, prepend=0)) if len(ends) == len(own) else self._one_by_one(own)
            flats.append(ids)
            sizes.append(n)
        return np.concatenate(flats), np.concatenate(sizes)

    def _by_parts(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of plain lower-cased words one after another, number of each), or None if the parts don't add up."""
        counts = pc.count_substring_regex(low, PARTS).to_numpy(zero_copy_only=False)
        parts = pa.array(PLAIN_PARTS.findall(joined(low)), pa.string()).dictionary_encode()
        if len(parts) != counts.sum() or (counts < 1).any():
            return None
        codes = parts.indices.to_numpy(zero_copy_only=False)
        flat, first, size = self.known_parts(parts.dictionary, self._together, np.ones(len(parts.dictionary), bool))
        total = np.concatenate([[0], np.cumsum(size[codes])])
        return gathered(flat, first[codes], size[codes]), np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, number of each)."""
        plain = pc.match_substring_regex(words, PLAIN)
        found = self._by_parts(pc.utf8_lower(words.filter(plain)))
        if found is None:
            return self._one_by_one(words)
        plain = plain.to_numpy(zero_copy_only=False)
        if plain.all():
            return found
        others = np.flatnonzero(~plain)
        flat, size = (np.concatenate(x) for x in zip(found, self._one_by_one(words.take(pa.array(others))), strict=True))
        order, n = np.concatenate([np.flatnonzero(plain), others]), np.empty(len(words), np.int64)
        first = np.empty(len(words), np.int64)
        n[order], first[order] = size, np.cumsum(size) - size
        return gathered(flat, first, n), n

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts one after another, offsets by text)."""
        codes, distinct, ends = word_codes(texts, lower=False)
        flat, first, size = self.known_words(distinct, self.words, np.bincount(codes, minlength=len(distinct)) > 1)
        n = size[codes]
        return gathered(flat, first[codes], n), np.concatenate([[0], np.cumsum(n)])[ends]


def encoder_of(path: str) -> WordEncoder | TextEncoder:
    """One encoder for each process, so that the next task finds the frequent words known."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if by_words(path) else TextEncoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, end_id: int, width: int, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, id, ids): the token ids of each text and the end id, packed, and the part that `bounds` give an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder_of(path), np.dtype(f"<u{width}")
        for rows in slices(batches, "text", 1 << 20):
            ids, ends = encode(rows.column("text"))
            n, part = len(ends) - 1, np.searchsorted(np.array(bounds, np.int64), rows.column("id").to_numpy(), side="right")
            packed = np.insert(ids, ends[1:], end_id).astype(kind)
            cut = (ends + np.arange(n + 1)) * width
            yield pa.record_batch({"part": pa.array(part.astype(np.int32)), "id": rows.column("id"), "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None,
                pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(packed)]).cast(pa.binary())})

    narrow = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "part int, id long, ids binary")


def part_bounds(docs: DataFrame, id_col: str, text_col: str, part_bytes: int = PART_BYTES) -> list[int]:
    """Ascending least ids of the parts but the first, from approximate quantiles of ids weighted by length of text.

    A document counts once for each average length that it has, rounded up, so no part has over twice its share.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 8
    sizes = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), size.alias("size"))
    n, total = sizes.agg(F.count("*"), F.sum("size")).first()
    parts = -(-(total or 0) // part_bytes)
    if parts < 2:
        return []
    counted = sizes.select("id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / (total / n)).cast("int"))))
    cuts = counted.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
    return sorted(set(cuts))


def write_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the parts under the URI `folder`; rows (part, n_docs, n_ids, base), one for each file."""
    width = 2 if tokenizer_of(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    bounds = part_bounds(docs, id_col, text_col, part_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        open_part, held = None, None

        def close() -> pa.RecordBatch:
            part, out, name, ids, ends = held
            out.close()
            index = MAGIC + np.array([width], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([0, *ends],
                "<u8").tobytes() + np.array(ids, "<i8").tobytes()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(index)
            for kind in ("bin", "idx"):
                target = f"{root}/part-{part:05d}.{kind}"
                if store.get_file_info(target).type != pyarrow.fs.FileType.NotFound:  # of an attempt before; some stores refuse to replace
                    store.delete_file(target)
                store.move(f"{name}.{kind}", target)
            return pa.record_batch({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                "n_ids": pa.array([ends[-1]], pa.int64())})

        for b in batches:
            for part, doc, ids in zip(b.column("part").to_pylist(), b.column("id").to_pylist(), b.column("ids"), strict=True):
                if part != open_part:
                    if held:
                        yield close()
                    name = f"{root}/.{part:05d}-{uuid.uuid4().hex}"
                    open_part, held = part, (part, store.open_output_stream(f"{name}.bin", buffer_size=1 << 20), name, [], [])
                data = ids.as_buffer()
                held[1].write(data)
                held[3].append(doc)
                held[4].append((held[4][-1] if held[4] else 0) + data.size // width)
        if held:
            yield close()

    rows = encoded(docs, path, end_id, width, bounds, id_col, text_col)
    # one part is one task
    totals = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "id", "ids").mapInArrow(write,
        "part int, n_docs long, n_ids long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    with bounded_batches(docs.sparkSession):
        return materialize(totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))))


def read_part(store: pyarrow.fs.FileSystem, root: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, offsets, token ids) of a part; token ids are a memory map where the store is a local folder."""
    name = f"{root}/part-{part:05d}"
    with store.open_input_file(f"{name}.idx") as f:
        head = f.read()
    if head[:4] != MAGIC:
        raise ValueError(f"{name}.idx isn't an index of token ids")
    width, n = int(np.frombuffer(head, "<u4", 1, 4)[0]), int(np.frombuffer(head, "<u8", 1, 8)[0])
    ends, docs = np.frombuffer(head, "<u8", n + 1, 16).astype(np.int64), np.frombuffer(head, "<i8", n, 24 + 8 * n)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return docs, ends, np.memmap(f"{name}.bin", f"<u{width}", "r") if os.path.getsize(f"{name}.bin") else np.zeros(0, f"<u{width}")
    with store.open_input_file(f"{name}.bin") as f:
        return docs, ends, np.frombuffer(f.read(), f"<u{width}")


def read_files(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the files: start counts all ids before the document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                docs, ends, ids = read_part(store, root, part)
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(ends, ends[1:], strict=False)]
                yield pa.record_batch({"doc_id": pa.array(docs, mask=docs == NO_ID), "start": pa.array(base + ends[:-1]),
                    "n_tokens": pa.array(np.diff(ends)), "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, parts.count())
    return parts.select("part", "base").repartition(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(folder: str, parts: list[tuple[int, int, int]], position: int) -> np.ndarray:
    """Ids of the document at a position in the whole order; parts: (part, n_docs, n_ids) in order."""
    firsts = np.cumsum([0, *(n for _, n, _ in parts)])
    k = bisect.bisect_right(firsts.tolist(), position) - 1
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    _, ends, ids = read_part(store, root, parts[k][0])
    i = position - int(firsts[k])
    return np.asarray(ids[ends[i] : ends[i + 1]])


def token_files(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, by default into a new folder beside the checkpoints, and read the documents back from them."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{os.path.abspath(folder)}"
    return read_files(spark, folder, write_files(docs, folder, path, end_id, id_col, text_col))
