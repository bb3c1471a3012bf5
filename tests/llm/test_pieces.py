"""SentencePiece merge-dropout: equal to the library without dropout, lossless and seeded with it."""

import random

import numpy as np
import sentencepiece

from tongueloom.llm.pieces import PieceEncoder, decode, encode, round_trip
from tongueloom.llm.queries import piece_codec
from tongueloom.llm.wordhash import mix

TEXTS = ["", " ", "  two  spaces ", "tabs\tand\nlines\n\n", "Straße déjà-vu 12,345.67 Ünïcödé", "日本語テキスト 👍🏽 مرحبا", "a b  c", "<s> </s> <unk> <0x0A>",
         "the cat " * 400, "x" * 3000, "NUL\x00 and \x1f", "▁literal a▁b ▁▁"]


def sample(seed=2, n=150):
    rnd = random.Random(seed)
    return TEXTS + ["".join(rnd.choices("abcdefghij  .,é\n", k=rnd.randint(1, 200))) for _ in range(n)]


def test_without_dropout_equals_the_library():
    plain = PieceEncoder(piece_codec(dropout=0.0))
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec().model)
    for text in sample():
        if "▁" not in text:
            assert plain.encode(1, text) == lib.encode(text), text[:60]


def test_words_side_by_side_equal_the_agenda_one_by_one():
    for dropout in (0.0, 0.1, 0.5):
        encoder = PieceEncoder(piece_codec(dropout=dropout, draws=1))
        for text in sample(seed=5):
            words, out = [], []
            for c in " " + text if text else "":
                stranger = encoder.model.char[ord(c)] < 0
                if not words or stranger or encoder.model.char[ord(words[-1][-1])] < 0 or (c == " " and words[-1][-1] != " "):
                    words.append("")
                words[-1] += c
            for w in words:
                if encoder.model.char[ord(w[0])] < 0:
                    out += [encoder.model.byte[x] for x in w.encode()]
                else:
                    out += encoder.model.segment(w.replace(" ", "▁"), int(encoder.draw_keys[0]), encoder.cut)
            assert encoder.encode(1, text) == out


def test_round_trip_nulls_and_other_columns(docs_of):
    rows = [*enumerate(sample()), (None, "no id at all"), (900, None), (7, TEXTS[7])]
    codec = piece_codec(dropout=0.3)
    df = docs_of(rows).selectExpr("*", "1 as ids", "2 as decoded", "3 as draw")
    got = decode(encode(df, codec), codec).collect()
    assert sorted(map(str, round_trip(df, codec).collect())) == sorted(map(str, got))
    assert len(got) == len(rows) and all(r.text == r.decoded and r.draw == 3 for r in got)
    assert [r.ids for r in got if r.text is None] == [None] and [r.ids for r in got if r.text == ""] == [[]]
    assert encode(docs_of([]), codec).count() == 0


def test_seed_and_document_decide_the_segmentation():
    text = "international understanding of multilingual tokenization " * 5
    one, again, other = PieceEncoder(piece_codec()), PieceEncoder(piece_codec()), PieceEncoder(piece_codec(seed=18))
    ids = {d: one.encode(d, text) for d in range(20)}
    assert all(again.encode(d, text) == ids[d] for d in reversed(range(20)))
    assert len({tuple(x) for x in ids.values()}) > 10 and any(other.encode(d, text) != ids[d] for d in range(20))
    plain = PieceEncoder(piece_codec(dropout=0.0)).encode(0, text)
    assert all(len(x) >= len(plain) for x in ids.values())
    assert PieceEncoder(piece_codec(dropout=1.0)).encode(0, "abc") == [one.model.id[c] for c in "▁abc"]


def test_a_small_cache_changes_nothing():
    big, small = PieceEncoder(piece_codec()), PieceEncoder(piece_codec(cache=6))
    for d, text in enumerate(sample()):
        assert big.encode(d, text) == small.encode(d, text)


def test_occurrences_are_drawn_one_by_one_at_the_rate_asked_for():
    one = PieceEncoder(piece_codec())
    word = "understanding"
    unit, n = "▁" + word, 4000
    plain = PieceEncoder(piece_codec(dropout=0.0)).encode(0, word)
    text = " ".join([word] * n)
    ids = one.encode(3, text)
    forms, now = [], []
    for k in ids:  # a word ends when its characters are all there
        now.append(k)
        if len(one.model.decode(now).strip()) == len(word):
            forms.append(tuple(now))
            now = []
    assert len(forms) == n and len(set(forms)) > 30  # eight keys give at most eight
    chars = one.model.char[[ord(c) for c in " " + word]]
    taken = one.model.segment_many(chars, np.array([0]), np.array([len(unit)]), np.empty((1, 0), dtype=np.int64))[2]
    alone = [one.model.segment(unit, k, one.cut) for k in mix(np.arange(n, dtype=np.uint64) + np.uint64(77)).tolist()]
    assert abs(sum(f == tuple(plain) for f in forms) - sum(f == tuple(plain) for f in alone)) / n < 0.05
    # every step of the undisturbed agenda is skipped in about a tenth of the draws, whatever the places
    draws = mix(np.arange(n, dtype=np.uint64))
    for c in taken.tolist():
        a, b, size = (np.full(n, x) for x in (c & 255, c >> 8 & 255, c >> 16))
        assert abs(one.model._skipped(draws, a, b, size, one.cut).mean() - 0.1) < 0.02


def test_each_occurrence_equals_the_agenda_with_its_own_key():
    one = PieceEncoder(piece_codec(dropout=0.3))
    keyed = []
    real = one.model._skipped
    one.model._skipped = lambda key, *rest: keyed.append(key) or real(key, *rest)
    words = "tokenization of the international understanding understanding of the".split()
    ids, draws = one.encode(8, " ".join(words)), keyed[0]
    of = list(dict.fromkeys(draws.tolist()))  # words of more than one candidate have one key each, in order
    assert len(of) == len(words) and ids == [k for w, key in zip(words, of) for k in one.model.segment("▁" + w, key, one.cut)]
