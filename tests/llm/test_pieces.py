"""Pieces against the sentencepiece library, and the way back."""

import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from anamnesis.llm.pieces import _Borders, _edges, decode, decode_ids, encode_batch, encode_texts, vocabulary
from anamnesis.llm.queries import PIECES

ODD = [
    "", " ", "  ", "a", " a", "a ", "hello world", " hello  world ", "a\nb\t c", "\x00a", "ﬁ Å é 　z\xa0y", "▁x ▁▁y",
    "née <s> </s> <0x41> <unk>", "a" * 2000, " " * 50 + "x", "🎉🎉 abc 日本語テキスト", "    def f():\n\t\treturn  1",
    "aaaaaaa bbbbbb abababab", "ñ́​", "\n\n\n  \n a", " " * 33, "x" + " " * 17, "▁", "háha",
]


def texts():
    rng = random.Random(6)
    alphabet = "aaabcdeeeinorstt  \n.é日🎉'-1"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 30, 300]))) for _ in range(300)]


def test_same_pieces_as_the_library(spark, table):
    own = texts() + [None]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sorted(encode_texts(table(own), PIECES).collect(), key=lambda r: r["key"])
    for r, text in zip(rows, own, strict=True):
        assert r["ids"] == (None if text is None else library.encode(text)), repr(text)
        assert r["same"] is (None if text is None else True)
        assert r["n_pieces"] == len(r["ids"] or [])


def test_round_trip(spark, table):
    own = texts() + [None]
    back = decode_ids(encode_texts(table(own), PIECES), PIECES)
    found = {r["key"]: r["text"] for r in back.collect()}
    assert [found[i] for i in range(len(own))] == [t and t.replace("▁", " ") for t in own]


def test_edges_are_all_occurrences():
    words = vocabulary(PIECES)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdehint er▁") for _ in range(400))
    codes = words.code[[ord(c) for c in text]]
    codes[rng.randrange(400)] = 0
    found = {(s, m, p) for s, m, p in zip(*(x.tolist() for x in _edges(words, codes)), strict=True)}
    want = set()
    by_text = {}
    for p, m in zip(words.piece_ids.tolist(), words.piece_len.tolist(), strict=True):
        by_text[words.bytes[p].decode().replace(" ", "▁")] = p, m
    plain = text.replace(" ", "▁")
    zero = np.flatnonzero(codes == 0)
    for a in range(400):
        for b in range(a + 1, min(a + words.width, 400) + 1):
            if plain[a:b] in by_text and not any(a <= z < b for z in zero):
                p, m = by_text[plain[a:b]]
                want.add((a, m, p))
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_decode_of_any_ids(seed):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(seed)
    words = vocabulary(PIECES)
    ids = [rng.randrange(259, 32000) for _ in range(200)]
    assert decode(words, ids) == library.decode(ids)


def test_empty_table(spark, table):
    assert encode_texts(table([]), PIECES).count() == 0
    words = vocabulary(PIECES)
    assert list(encode_batch(words, _Borders(words), pa.array([], pa.string()))) == []


def test_stretches_are_laid_out_once(monkeypatch):
    from anamnesis.llm import pieces

    words = pieces.vocabulary(PIECES)
    borders, seen = pieces._Borders(words), []
    encode = pieces._encode_stretches
    monkeypatch.setattr(pieces, "_encode_stretches", lambda w, b, points, first: seen.append(len(first) - 1) or encode(w, b, points, first))
    monkeypatch.setattr(pieces, "KEPT_STRETCHES", 6)
    batches = [[" a word and a word", None, ""], [" a word é", " and more"], [" b c d e f g"], [" a word and more"]]
    for texts in batches:
        found = list(pieces.encode_batch(words, borders, pa.array(texts, pa.string())))
        alone = list(pieces.encode_batch(words, pieces._Borders(words), pa.array(texts, pa.string())))
        seen.pop()
        for (_, ids, cuts), (_, own, at) in zip(found, alone, strict=True):
            assert ids.tolist() == own.tolist() and cuts.tolist() == at.tolist()
    # Three stretches, two new ones, six new ones, and after these too many are kept, so all are new again.
    assert seen == [3, 2, 6, 4]
