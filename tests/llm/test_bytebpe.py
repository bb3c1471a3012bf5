"""Byte-level BPE against the library on whole texts, and the tree against direct merging."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tongueloom.llm.bytebpe import ByteBPE, ByteCodec, decode, encode, packed, units, unpacked
from tongueloom.llm.queries import QUERIES, byte_codec

SF = "/root/testdata/sf0.001"
ODD = ["ab", " ", "  ", "\n", "\t ", "é", "日本", "🙂", "'s", "'LL", "123", "--", "\x1c", "\x85", "　", "aaaa", "the", " the", "ʰ", "²", "​", "_", "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    with open(byte_codec().ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 8, 1000])
def test_any_leaf_gives_the_ids_of_the_library(library, leaf):
    codec = byte_codec()
    bpe, rnd = ByteBPE(ByteCodec(codec.ranks, codec.pattern, leaf=leaf)), random.Random(leaf)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 30))) for _ in range(800)]
    texts += ["a" * 4097, "ab" * 3000 + "a", " " * 999 + "x", "é" * 2001, "xyz" * 1000, "\n" * 77 + "z", "w" * 30_000 + " end"]
    for text in texts:
        ids = bpe.encode(text)
        assert unpacked(ids) == library.encode_ordinary(text)
        assert bpe.decoded(unpacked(ids)) == text.encode()


def test_joins_of_any_cut_equal_the_whole(library):
    bpe, rnd = ByteBPE(byte_codec()), random.Random(5)
    for _ in range(300):
        raw = "".join(rnd.choices(["a", "b", "an", "na", "é", "the", "0", "ing"], k=rnd.randint(2, 60))).encode()
        cut = rnd.randint(0, len(raw))
        assert bpe.joined(bpe.merged(raw[:cut]), bpe.merged(raw[cut:])) == bpe.merged(raw)


def test_units_cut_only_between_words():
    assert units("a b  c\n d e ") == ["a", "b  c\n d", "e "] and units("") == [""] and units(" x y") == [" x", "y"]


def test_columns_rows_and_odd_cases(spark, docs_of, library):
    texts = [None, "", " ", "twice twice", "twice twice", "long " * 30_000, "日本語 text"]
    df = docs_of([(None if i == 6 else i // 2, t) for i, t in enumerate(texts)]).selectExpr("*", "'x' as ids", "1 as decoded", "2 as stop")
    codec = byte_codec()
    out = decode(encode(df, codec), codec)
    assert out.columns == [c for c in df.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    got = sorted((r.text or "", unpacked(bytes(r.ids)), bytes(r.decoded).decode()) for r in out.collect())
    assert got == sorted((t or "", library.encode_ordinary(t or ""), t or "") for t in texts)
    assert decode(encode(docs_of([]), codec), codec).count() == 0
    small = ByteCodec(codec.ranks, codec.pattern, cache=2)
    assert sorted(bytes(r.ids) for r in encode(df, small, keep=[]).collect()) == sorted(bytes(r.ids) for r in out.collect())
    nulls = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert {r.ids is None: r.decoded for r in decode(nulls, codec).collect()} == {True: None, False: b""}


def test_registered_query(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_bytetree"](spark, SF).collect()} == want
