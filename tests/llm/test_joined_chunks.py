"""New chunks are encoded many to a text, with the ids that each has alone."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces
from tests.llm.test_llm import hand_made_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["\n", "\n\n", " ", "▁", "\r\n", "\t", "<0x0A>", "<0x0a>", "<unk>", "\0", "é", "漢字", "🙂", " ", "\x0b"]


def passed(model, monkeypatch):
    """The texts that the model is given from here on."""
    seen, ids = [], model.ids
    monkeypatch.setattr(model, "ids", lambda texts: seen.extend(texts) or ids(texts))
    return seen


def test_few_texts_for_many_chunks(monkeypatch):
    enc = pieces.PieceEncoder(PATH)
    seen = passed(enc.model, monkeypatch)
    text = "\n".join(f"word{i} {i}x" for i in range(3200))
    (ids,) = enc.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == enc.peer.encode(text)
    assert len(enc.cache) > 6400 and len(seen) < 6400 / 32


@given(st.lists(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(ODD)), max_size=30).map("".join), max_size=8))
@settings(max_examples=300, deadline=None)
def held(enc, texts):
    """Against the model's ids of each chunk alone, and the SentencePiece library's of each text."""
    forms = [enc.model.normalised(x) for x in texts]
    alone = [[i for c in enc.chunks(x) for i in enc.model.ids([c])[0]] for x in forms]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]
    assert got == alone == [enc.peer.encode(x) for x in texts]


def test_same_ids_as_alone():
    enc = pieces.PieceEncoder(PATH)
    held(enc=enc)
    assert "\n" in enc.cache


def test_same_ids_when_the_cache_is_emptied_each_time(monkeypatch):
    enc = pieces.PieceEncoder(PATH, most=0)
    monkeypatch.setattr(enc, "JOINED", 2)
    held(enc=enc)


def test_unigram_chunks_stay_alone(tmp_path, monkeypatch):
    enc = pieces.PieceEncoder(hand_made_model(tmp_path / "unigram.model", 1, 0, 1))
    seen = passed(enc.model, monkeypatch)
    enc.encode(["the cab\nabc"])
    assert enc.model.apart and enc.line is None and not any("\n" in x and x != "\n" for x in seen)
