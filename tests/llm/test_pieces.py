"""Pieces that are new to a worker reach the tokenizer many at a time, with the ids of whole texts."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from mailgrain.llm.tokens import PieceEncoder

TEXTS = [
    "it's 0 o'clock, 10 past 00:00 -- don't 0x0F ''s 's0 't", "Straße ÀÉ µm ª º x0y0 ...!?", " \t0\n", "0", "", None, "§§ €uro 日本 0 語 \x07 bell",
    " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q" for i in range(1500)), "a" * 300 + " " + "'" * 50, "<s> </s> [UNK] [CLS]0[SEP] <|x|>",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(name):
    encoder = PieceEncoder(public_tokenizers.path(name))
    want = [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    for _ in range(2):  # new pieces, then known ones
        assert [ids.tolist() for ids in encoder.column(pa.array(TEXTS))] == want


def test_new_pieces_share_calls(monkeypatch):
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    sent, plain = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: sent.extend(texts) or plain(texts))
    encoder.column(pa.array([TEXTS[7]]))
    assert 0 < len(sent) < 100  # was one for each of the pieces


def test_pieces_a_joined_text_would_not_tell_apart():
    encoder = PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = ["0", "abc", "a0b", "", "​", "x y", "don't"]
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder._encode_pieces(pieces)] == [
        x.ids for x in encoder.tokenizer.encode_batch(pieces, add_special_tokens=False)]
