"""Subword tokenizers against their libraries, text by text."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sparkcorpus.operators import chunking, tokenizers
from sparkcorpus.operators.tokenizers import FileTokenizer
from sparkcorpus.plans import queries

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "a", " a  b ", "don't 123", "日本語のテキスト 🙂🙂👩‍👩‍👧 é ﬁ", "a\x1cb\tc\n\n", "▁a ▁", "é ▁ é ▁", "<|endoftext|> <s>", "\x00", "ｆｕｌｌ ½", "x" * 500]


def path(name):
    return public_tokenizers.path(name)


def of(name):
    return FileTokenizer(path(name), pattern=public_tokenizers.PATTERN)


def by_library(name):
    """Spans of one text as the library gives them."""
    if name.endswith(".json"):
        own = Tokenizer.from_file(path(name))
        return lambda t: [(a, z) for a, z in own.encode(t, add_special_tokens=False).offsets if z > a]
    if name.endswith(".model"):
        own = SentencePieceProcessor(model_file=path(name))

        def pieces(t):
            """A byte token of a character spans the character, where the library gives its bytes to one of them."""
            body, out, at = f" {t}".encode(), [], 0
            for i in own.encode(t):
                part = bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
                chars = [k for k, c in enumerate(f" {t}") for _ in c.encode()]
                if body[at : at + len(part)] != part:
                    return None
                out.append((max(chars[at] - 1, 0), chars[at + len(part) - 1]))
                at += len(part)
            return [(a, z) for a, z in out if z > a]

        def whole(t):
            chars = [k for k, c in enumerate(t) for _ in c.encode()]
            return [(chars[p.begin], chars[p.end - 1] + 1) for p in own.encode(t, return_type="proto").pieces if p.end > p.begin]

        return lambda t: pieces(t) or whole(t)
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path(name), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans(t):
        chars, out, at = [k for k, c in enumerate(t) for _ in c.encode()], [], 0
        for part in own.decode_tokens_bytes(own.encode_ordinary(t)):
            out.append((chars[at], chars[at + len(part) - 1] + 1))
            at += len(part)
        return out

    return spans


NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"]


@pytest.mark.parametrize("name", NAMES)
def test_spans_are_those_of_the_library(spark, name, monkeypatch):
    monkeypatch.setattr(tokenizers, "SLICE_CHARS", 50)
    one = by_library(name)
    assert [[*zip(a.tolist(), z.tolist(), strict=True)] for a, z in of(name).batch(ODD)] == [one(t) for t in ODD]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 5000").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    found = tokenizers.count_tokens(chunking.token_offsets(docs, tokenizer=of(name)), of(name), name="n").collect()
    for r in found:
        want = one(r.text or "")
        assert [*zip(r.token_starts, r.token_ends, strict=True)] == want and r.n == len(want)


def test_byte_level_files_of_two_libraries_agree(spark):
    spans = [[(a.tolist(), z.tolist()) for a, z in of(n).batch(ODD[:8])] for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    assert spans[0] == spans[1]


def test_chunks_of_subword_tokens(spark):
    """Fixed windows from the library's offsets; no chunk of either strategy has over its tokens, none of the text is lost."""
    one, texts = by_library("piece_bpe_32k.model"), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 5000").collect()}
    got = {}
    for r in queries.QUERIES["c2_subword_chunks"](spark, SF).orderBy("document_id", "ordinal").collect():
        got.setdefault(r.document_id, []).append((r.start, r.end, r.token_start, r.token_end, r.text))
    for d, text in texts.items():
        spans = one(text)
        want = [(spans[a][0], spans[z - 1][1], a, z) for a, z in chunking.fixed_windows(len(spans), 200, 20)]
        assert got.get(d, []) == [(*w, hashlib.md5(text[w[0] : w[1]].encode()).hexdigest()) for w in want]
    rows = queries.QUERIES["c4_subword_chunks"](spark, SF)
    assert rows.where("token_end - token_start > 200").count() == 0
    tokens = chunking.token_offsets(spark.read.parquet(f"{SF}/documents.parquet"), tokenizer=of("byte_bpe_50k.json")).select(F.col("doc_id").alias("document_id"), F.size("token_starts").alias("n"))
    last = rows.groupBy("document_id").agg(F.max("token_end").alias("last"))
    assert last.join(tokens, "document_id").where("last <> n").count() == 0


def test_files_that_are_not_right(tmp_path):
    digest = of("byte_bpe_50k.json").identity.split(":")[1]
    assert FileTokenizer(path("byte_bpe_50k.json"), digest)("a b")[0] == [0, 1]
    other = tmp_path / "x.txt"
    other.write_text("x")
    for wrong in (FileTokenizer(path("byte_bpe_50k.json"), "0" * 64), FileTokenizer("/nowhere.json"), FileTokenizer(str(other)), FileTokenizer(path("byte_bpe_50k.tiktoken"))):
        with pytest.raises(tokenizers.TokenizerFileError):
            wrong("a")
