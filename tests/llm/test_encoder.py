"""Texts encoded in pieces have the ids of whole ones."""

import pytest
from hypothesis import given, settings, strategies as st

from flowlens.llm.token_ids import END, Encoder, public_vocabulary

ENCODER = Encoder(public_vocabulary())
PARTS = st.sampled_from([
    "it's", "'s", "'", "a", "Straße", "中文", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\u2028", "\u3000", "é", "½", "Ⅷ", "12", "!",
    "<|endoftext|>", "\x1c", "\x00", "\x7f", "🙂", "\x85", "Â\xa0", "…", " x", "\ny", "\u0301", "\u1680", "à", "Ġ"])


def whole(texts):
    return [e.ids + [END] for e in ENCODER.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=25).map("".join), max_size=8))
def test_texts_of_hard_parts(texts):
    assert [list(ids) for ids in ENCODER.encode(texts)] == whole(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_texts(texts):
    assert [list(ids) for ids in ENCODER.encode(texts)] == whole(texts)


@pytest.mark.parametrize("text", ["word, " * 50_000, " " * 20_000 + "x", "x" * 20_000, "é " * 10_000, "a1" * 10_000])
def test_long_texts(text):
    assert [list(ids) for ids in ENCODER.encode([text, "", text])] == whole([text, "", text])


def test_forgets_when_full(monkeypatch):
    from flowlens.llm import token_ids
    monkeypatch.setattr(token_ids, "WORDS_KEPT", 10)
    encoder = Encoder(public_vocabulary())
    for n in range(30):
        texts = [f"text {n} of {n * 7} words", "and more"]
        assert [list(ids) for ids in encoder.encode(texts)] == whole(texts)
