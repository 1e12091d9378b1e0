"""Alignment of two tokenizers: which tokens of one cover the bytes of which tokens of the other.

A is a byte-level tokenizer of the tokenizers library, B a sentencepiece model with byte fallback. Both encode a blank and the
text (B adds the blank itself). Where a token of A and one of B end at the same byte, the two id lists are cut into groups; a
link is a pair of tokens, one of A and one of B, whose bytes overlap.

1. For each text, dictionaries lead from the byte at which a token ends to its place, one for A and one for B. The keys that
   both have, sorted, slice the two id lists into groups, and links are expanded in each slice.
2. A text is handled in pieces, cut before a single blank between two characters that aren't white space. Both tokenizers
   always end a token there: A's pattern starts a new part at such a blank, and no piece of B has a blank after another
   character. So a distinct piece is aligned once, and documents are sums over pieces. This is done only if both tokenizers
   say of themselves that it's right (`by_pieces`), else, and for texts with a piece that doesn't give its bytes back, whole
   texts are aligned.
3. Corpus-wide counts of linked ids need the whole corpus before any document can be scored. Documents are put in blocks of
   about BLOCK_BYTES of text: a block lists its distinct id pairs once, with their number, and its documents refer to them. Pairs
   are summed over blocks, and the sums go back to each block, so that what is shuffled is a row for each pair of a block and
   not for each link. The blocks are written once; texts are read and encoded once.
4. A block is one row of packed bytes and a short row for each pair, and both are brought together by a sort, row by row: Spark
   holds as many blocks at a time as one, however many a task has.

Edge cases: null and empty texts, and texts whose tokens don't give back a blank and the text, have no tokens: zeros, and no
groups. Strings of special tokens are plain text. A very long text is one block, in memory some 20 times. Rows with null or equal ids, and equal
rows, are rows of their own. Ties for the highest count of a B id are all best. Other columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, written

#: Text of one block, about, and pieces that are encoded together.
BLOCK_BYTES, TOGETHER = 4 << 20, 1024
#: Where a text is cut.
CUT = re.compile(r"(?<=\S) (?=\S)")

_aligners: dict[tuple[str, str], Aligner] = {}


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others
    are numbered from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of ranges of these sizes, one range after another."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class Aligned:
    """Pieces of text, one after another as one row of bytes: ids of A and of B, the groups, and the links.

    a, b: ids; a_cut, b_cut: the ends of the groups in both; links: A * 2**32 + B. a_at, b_at, group_at and link_at are the offsets
    of the pieces in them: piece i has the tokens a[a_at[i]:a_at[i + 1]].
    """

    PARTS = ("a", "b", "a_cut", "b_cut", "links")

    def __init__(self, a: list[int], b: list[int], sizes: list[int], a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end, starts = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b]), np.cumsum([0, *sizes])
        a_place = dict(zip(a_end.tolist(), range(1, len(a) + 1), strict=True))
        b_place = dict(zip(b_end.tolist(), range(1, len(b) + 1), strict=True))
        cuts = sorted(a_place.keys() & b_place.keys())
        self.a_cut, self.b_cut = (np.fromiter(map(place.__getitem__, cuts), np.int64, len(cuts)) for place in (a_place, b_place))
        self.a_at, self.b_at, self.group_at = (np.searchsorted(x, starts, "right") for x in (a_end, b_end, np.array(cuts, np.int64)))
        # in a slice, each end of a token, of A or of B, closes one overlap of the two tokens there
        closed = np.array(sorted(a_place.keys() | b_place.keys()), np.int64)
        self.link_at = np.searchsorted(closed, starts, "right")
        self.links = (self.a[np.searchsorted(a_end, closed)] << 32) + self.b[np.searchsorted(b_end, closed)]

    def groups(self) -> list[bytes]:
        """The groups of each piece as text, each group with a semicolon after it.

        All ids are written at once: in the order of the text, as rows of digits and the mark that follows.
        """
        a_n, b_n = np.diff(self.a_cut, prepend=0), np.diff(self.b_cut, prepend=0)
        a_place = np.arange(len(self.a)) + np.repeat(self.b_cut - b_n, a_n)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_cut, b_n)
        ids, mark = np.empty(len(a_place) + len(b_place), np.int64), np.full(len(a_place) + len(b_place), ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        mark[a_place[self.a_cut - 1]], mark[b_place[self.b_cut - 1]] = ord("|"), ord(";")
        digits = len(str(int(ids.max(initial=0))))
        power = 10 ** np.arange(digits - 1, -1, -1)
        rows = np.empty((len(ids), digits + 1), np.uint8)
        rows[:, :-1], rows[:, -1] = ids[:, None] // power % 10 + ord("0"), mark
        shown = np.ones(rows.shape, bool)
        shown[:, : digits - 1] = ids[:, None] >= power[:-1]
        body = rows[shown].tobytes()
        at = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])[self.a_at + self.b_at].tolist()
        return [body[p:q] for p, q in zip(at, at[1:], strict=False)]

    @classmethod
    def joined(cls, parts: list[Aligned]) -> Aligned:
        """The pieces of several parts."""
        out, base = cls.__new__(cls), {c: np.cumsum([0, *(len(getattr(p, c)) for p in parts)]) for c in cls.PARTS}
        for c, of in (("a", None), ("b", None), ("links", None), ("a_cut", "a"), ("b_cut", "b")):
            setattr(out, c, np.concatenate([np.zeros(0, np.int64), *(getattr(p, c) + (0 if of is None else base[of][i]) for i, p in enumerate(parts))]))
        for c, of in (("a_at", "a"), ("b_at", "b"), ("group_at", "a_cut"), ("link_at", "links")):
            setattr(out, c, np.concatenate([*(getattr(p, c)[:-1] + base[of][i] for i, p in enumerate(parts)), base[of][-1:]]).astype(np.int64))
        return out


class Aligner:
    """Aligns texts for one pair of tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        value, byte = byte_values(), re.compile(r"<0x([0-9A-F]{2})>")
        own = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(t)) else t.replace("▁", " ").encode() for t in pieces]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.pieces = self.by_pieces(pieces)

    def by_pieces(self, pieces: list[str]) -> bool:
        """Whether both tokenizers end a token at every cut, by their own descriptions."""
        kind = json.loads(self.a.to_str())
        a = kind["normalizer"] is None and not any(any(c.isspace() for c in t["content"]) or not t["special"] for t in kind["added_tokens"])
        split = kind["pre_tokenizer"] or {}
        a = a and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        from sentencepiece import sentencepiece_model_pb2 as model

        own = model.ModelProto.FromString(self.b.serialized_model_proto())
        b = own.normalizer_spec.name == "identity" and own.normalizer_spec.add_dummy_prefix and not own.normalizer_spec.remove_extra_whitespaces
        return bool(a and b and not any("▁" in t.lstrip("▁") for t in pieces))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of A and of B for each text; None for one whose tokens don't give it back."""
        a = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        out: list[tuple[list[int], list[int]] | None] = []
        for text, x, y in zip(texts, a, self.b.encode(texts, num_threads=1), strict=True):
            x, whole = x.ids, f" {text}".encode()
            same = b"".join(map(self.a_bytes.__getitem__, x)) == whole == b"".join(map(self.b_bytes.__getitem__, y))
            out.append((x, y) if same else None)
        return out

    def cut(self, texts: pa.Array) -> tuple[list[list[str]], list[np.ndarray]]:
        """(distinct pieces, first those that can stand side by side, then the others; the pieces of each text by place).

        Most texts have no white space beside a blank: their pieces are what is between blanks.
        """
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), ends - ends[0]
        edge = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        odd = np.diff(np.concatenate([[0], np.cumsum(edge[codes])])[ends]) > 0 if self.pieces else np.ones(len(texts), bool)
        used = np.zeros(len(words), bool)
        used[codes[np.repeat(~odd, np.diff(ends))]] = True
        # pieces of the other texts, which may be among the words once more
        own = {int(k): ([] if not t else CUT.split(t) if self.pieces else [t]) for k in np.flatnonzero(odd) for t in (texts[int(k)].as_py(),)}
        more = dict.fromkeys(p for pieces in own.values() for p in pieces)
        alone = [p for p in more if not self.pieces or p[0].isspace() or p[-1].isspace()]
        inner = [words[i] for i in np.flatnonzero(used)] + [p for p in more if self.pieces and not (p[0].isspace() or p[-1].isspace())]
        more.update(zip(inner[int(used.sum()) :] + alone, range(int(used.sum()), len(inner) + len(alone)), strict=True))
        codes = (np.cumsum(used) - 1)[codes]
        of = [np.fromiter(map(more.__getitem__, own[k]), np.int64, len(own[k])) if k in own else codes[ends[k] : ends[k + 1]] for k in range(len(texts))]
        return [inner, alone], of

    def texts(self, texts: pa.Array, named: bool = True) -> tuple[Aligned, list[np.ndarray], list[bytes]]:
        """(distinct pieces, the pieces of each text by place, the groups of each piece as text if `named`). Texts without
        tokens have no pieces."""
        (inner, alone), of = self.cut(texts)
        done: list[Aligned] = []
        groups: list[bytes] = []
        odd: set[int] = set()

        def add(part: list[str], together: bool) -> None:
            nonlocal count
            a, b, sizes = [], [], [len(p.encode()) + 1 for p in part]
            found = self.encode([" ".join(part)]) if together else [None]
            for i, ids in enumerate(found if found[0] is not None else self.encode(part)):
                if ids is None:
                    odd.add(count + i)
                    sizes[i] = 0
                else:
                    a += ids[0]
                    b += ids[1]
            count += len(part)
            done.append(Aligned(a, b, sizes, self.a_size, self.b_size))
            if named:
                groups.extend(done[-1].groups())

        count = 0
        for pieces, together in ((inner, True), (alone, False)):
            for x in range(0, len(pieces), TOGETHER):
                add(pieces[x : x + TOGETHER], together)
        for k in [k for k, own in enumerate(of) if odd and not odd.isdisjoint(own.tolist())]:
            of[k] = np.zeros(0, np.int64)
            if self.pieces:  # whole, in case it was the cut that made the difference
                add([texts[k].as_py()], False)
                if count - 1 not in odd:
                    of[k] = np.array([count - 1])
        return Aligned.joined(done), of, groups


def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for each process, as its vocabularies take a second to load."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, a, b, a_ends, b_ends), one for each row of docs: ids of A and of B, and the ends of the groups in both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner_of(a_path, b_path)
        for part in slices(batches, "text", BLOCK_BYTES):
            found, of, _ = own.texts(part.column("text"), named=False)
            cuts, rows = {"a": found.a_cut, "b": found.b_cut}, {c: [] for c in ("a", "b", "a_ends", "b_ends")}
            for pieces in of:
                groups = spread(found.group_at[pieces], found.group_at[pieces + 1] - found.group_at[pieces])
                for side, ids, at in (("a", found.a, found.a_at), ("b", found.b, found.b_at)):
                    rows[side].append(ids[spread(at[pieces], at[pieces + 1] - at[pieces])].astype(np.int32))
                    before = np.concatenate([[0], cuts[side]])
                    rows[f"{side}_ends"].append(np.cumsum(before[groups + 1] - before[groups]).astype(np.int32))
            yield pa.record_batch({"id": part.column("id"), **{c: pa.array(x, pa.list_(pa.int32())) for c, x in rows.items()}})

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def packed(parts: dict[str, pa.Array]) -> bytes:
    """Arrays of any lengths as bytes."""
    row = pa.record_batch({c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in parts.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpacked(body: pa.Buffer) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(body, options=pa.ipc.IpcReadOptions(use_threads=False)).read_next_batch()
    return {c: row.column(c)[0].values for c in row.schema.names}


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, body, at, pair, n). A block has one row with a body: documents with their sums and pieces, and pieces with their
    links as places of pairs; and a row for each of its distinct pairs of linked ids, with its place and number."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = aligner_of(a_path, b_path), (TaskContext.get().partitionId() << 33) - 1
        # batches are about a block; one that is a little more isn't cut
        for part in slices(batches, "text", BLOCK_BYTES + BLOCK_BYTES // 4):
            found, of, groups = own.texts(part.column("text"))
            block += 1
            size = np.stack([np.diff(x) for x in (found.a_at, found.b_at, found.group_at, found.link_at)], axis=1)
            times, rows = np.zeros(len(size), np.int64), []
            for pieces in of:
                codes, n = np.unique(pieces, return_counts=True)
                times[codes] += n
                print_ = hashlib.sha256(b"".join(map(groups.__getitem__, pieces.tolist()))[:-1]).hexdigest() if len(pieces) else ""
                rows.append((codes.astype(np.int32), n, *(n @ size[codes]).tolist(), print_))
            ends, (pairs, at) = found.link_at.astype(np.int32), np.unique(found.links, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, at, np.repeat(times, np.diff(ends)))
            codes = pa.array([r[0] for r in rows], pa.list_(pa.int32()))
            doc = pa.StructArray.from_arrays([part.column("id"), *(pa.array([r[2 + k] for r in rows], pa.int64()) for k in range(4)),
                pa.array([r[6] for r in rows], pa.string()), codes, pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pieces", "times"])
            body = packed({"docs": doc, "ends": pa.array(ends), "links": pa.array(at.astype(np.int32))})
            del found, of, groups, rows, codes, doc
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([body], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                pa.nulls(1, pa.int64())], ["block", "body", "at", "pair", "n"])
            yield pa.record_batch([pa.array(np.full(len(pairs), block)), pa.nulls(len(pairs), pa.binary()), pa.array(np.arange(len(pairs), dtype=np.int32)),
                pa.array(pairs), pa.array(total)], ["block", "body", "at", "pair", "n"])

    return narrow.mapInArrow(run, "block long, body binary, at int, pair long, n long")


def pair_counts(made: DataFrame) -> DataFrame:
    """Rows (pair, n, best): how many links of the corpus hold a pair of ids, and whether no pair with its B id has more."""
    each = written(made.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = each.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row for each id of B
    return each.join(F.broadcast(highest), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(parts: dict[str, pa.Array], score: np.ndarray) -> pa.RecordBatch:
        """Rows of a block's documents; score: of each pair, twice its count, and one more if it's a best one."""
        doc, ends, links = parts["docs"], parts["ends"].to_numpy(), parts["links"].to_numpy()
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends]) for x in (score >> 1, score & 1)]
        pieces, times = doc.field("pieces"), doc.field("times")
        at = pieces.offsets.to_numpy()
        codes, n = pieces.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        total, good = (np.diff(np.concatenate([[0], np.cumsum(x[codes] * n)])[at - at[0]]) for x in sums)
        return pa.record_batch({**{c: doc.field(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(good, pa.int64()),
            "count_sum": pa.array(total, pa.int64()), "groups_sha256": doc.field("groups_sha256")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, score = None, np.zeros(0, np.int64)
        for batch in batches:
            order = batch.column("order").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x and order[x] % 2:
                    score[batch.column("at").slice(x, y - x).to_numpy()] = batch.column("score").slice(x, y - x).to_numpy()
                elif y > x:
                    if parts is not None:
                        yield scored(parts, score)
                    parts = unpacked(batch.column("body")[x].as_buffer())
                    score = np.zeros((pc.max(parts["links"]).as_py() or 0) + 1, np.int64)
        if parts is not None:
            yield scored(parts, score)

    with bounded_batches(docs.sparkSession, BLOCK_BYTES):
        made = written(blocks(docs, a_path, b_path, id_col, text_col), "aligned")
        scores = made.where("pair is not null").select("block", "at", "pair").join(pair_counts(made), "pair").select((F.col("block") * 2 + 1).alias("order"),
            "at", (F.col("n") * 2 + F.col("best").cast("long")).alias("score"))
        both = made.where("body is not null").select((F.col("block") * 2).alias("order"), "body").unionByName(scores, allowMissingColumns=True)
        both = both.repartition(F.shiftright("order", 1)).sortWithinPartitions("order")  # a body, then its pairs
        return written(both.mapInArrow(run,
            f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "alignment")
