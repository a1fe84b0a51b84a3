"""Ids back to texts: decode_pieces() against the SentencePiece library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces
from tests.llm.test_llm import LONG, TEXTS, hand_made_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


def held(enc, odd):
    """Any ids, with those of bytes, marks and pieces without text more often."""
    n = len(enc.model.pieces)

    @given(st.lists(st.one_of(st.integers(0, n - 1), st.sampled_from(odd)), max_size=12))
    @settings(max_examples=300, deadline=None)
    def same(ids):
        assert enc.text(ids) == (enc.peer.decode(ids) if ids else "")

    same()


def odd_ids(model):
    marks = [i for i, p in enumerate(model.pieces) if p.strip(pieces.MARK) == ""][:4]
    starts = [i for i, p in enumerate(model.pieces) if p.startswith(pieces.MARK)][:8]
    letters = [model.byte_ids[b] for b in "漢 é🙂\0".encode() if model.byte_ids]
    return marks + starts + letters + [i for i, t in enumerate(model.types) if t in (pieces.UNKNOWN, pieces.CONTROL, pieces.USER)]


def test_any_ids_of_the_large_model():
    enc = pieces.encoder(PATH)
    held(enc, odd_ids(enc.model))


@pytest.mark.parametrize("fallback", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_any_ids_of_small_models(tmp_path, fallback, squeeze, prefix):
    enc = pieces.PieceEncoder(hand_made_model(tmp_path / "unigram.model", fallback, squeeze, prefix))
    held(enc, odd_ids(enc.model))


def test_round_trip_as_tables(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in TEXTS], "doc_id long, text string, parity string")
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PATH), PATH)
    assert all(r.parity for r in back.collect())
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in TEXTS)
    assert {r.doc_id: r.text for r in back.collect()}[5] == LONG


def test_nulls_and_numbers_without_piece(spark):
    n = len(pieces.encoder(PATH).model.pieces)
    rows = [(1, None, 0), (2, [], 0), (None, [None, n, -1, 2**40], 0), (4, [None, 0, 1, 2], 0), (4, [None, 0, 1, 2], 0)]
    df = spark.createDataFrame(rows, "doc_id int, ids array<long>, text int")
    got = pieces.decode_pieces(df, PATH).collect()
    assert len(got) == 5 and all(r.parity for r in got)
    assert [r.text for r in got if r.doc_id in (1, 2)] == ["", ""]
    assert [r.text for r in got if r.doc_id is None] == [pieces.UNKNOWN_TEXT * 3]
    assert pieces.decode_pieces(df.limit(0), PATH).count() == 0
