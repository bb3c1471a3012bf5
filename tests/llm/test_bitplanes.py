"""Bit-plane files: exact round trips, the library's ids, order and starts."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tongueloom.llm.bitplanes import PlaneFile, ShardReader, WordEncoder, from_planes, read_tokens, to_planes, token_folder, write_tokens
from tongueloom.llm.queries import TOKENIZERS

FILE = f"{TOKENIZERS}/word_bpe_49k.json"
TEXTS = ["Plain words, twice words.", None, "", "  \n\t ", "It's I'LL don't “quoted” ’s 'S", "ÀÉ ΟΔΟΣ İstanbul Å", "12.5%,x-y ß—z 007", "日本語 x²½ﬁ",
         "<|endoftext|> <|ENDOFTEXT|> <|startoftext|", "w" * 5000, "long text " * 20_000, "a b\x1cq\x85z", "Plain words, twice words."]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("top", [0, 1, 255, 256, 49407, 2**32 - 1])
def test_planes(bits, top):
    for n in (0, 1, 7, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
        planes = to_planes(ids, bits)
        assert (from_planes(planes, n, bits) == ids).all() and len(planes) <= 32 // bits


def expected(rows):
    tokenizer, at, out = Tokenizer.from_file(FILE), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("p", [PlaneFile(), PlaneFile(chunk=100, bits=8), PlaneFile(chunk=1, cache=3)])
def test_files_hold_the_ids_in_order(spark, docs_of, p):
    texts = [t if p.chunk > 1 or t is None else t[:60] for t in TEXTS]
    rows = [(31 - 3 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (31, texts[0]), (10**12, "x")]
    df = docs_of(rows).selectExpr("*", "1 as shard", "2 as path", "3 as ids").repartition(5)
    folder = token_folder(df)
    got = read_tokens(write_tokens(df, folder, FILE, 2, p), folder).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got) == sorted((s, d, n, c) for d, s, n, c in expected(rows))


def test_empty_table_and_cut_file(docs_of, tmp_path):
    df = docs_of([])
    folder = token_folder(df)
    assert read_tokens(write_tokens(df, folder, FILE, 2), folder).count() == 0
    (tmp_path / "cut").write_bytes(b"IDPLANE1" + bytes(40))
    from pyarrow import fs

    with pytest.raises(ValueError):
        ShardReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "cut")))


def test_words_one_by_one_equal_whole_texts():
    encoder, tokenizer = WordEncoder(FILE, 1000), Tokenizer.from_file(FILE)
    assert encoder.direct
    texts = [t for t in TEXTS if t]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
