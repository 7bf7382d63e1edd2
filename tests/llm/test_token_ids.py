"""op9_packing: ids by chunks between spaces equal the tokenizer's."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from curul.llm import packing  # noqa: E402


def test_chunks_equal_the_tokenizer():
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    draws = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "a", "ñandú", "'s", "'S", "don't", "1", "２", "日本", "🙂", "é", "...", "-", "_", "\x00", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(draws.choices(parts, k=draws.randint(0, 14)))
        assert ids(text) == ids._encode(text), repr(text)


def test_known_chunks_are_not_split_again(monkeypatch):
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    ids("uno dos, tres\ncuatro")
    seen = []
    monkeypatch.setattr(ids, "split", lambda text: seen.append(text) or ["uno"])
    assert ids("uno tres\ncuatro dos,") == ids._encode("uno tres\ncuatro dos,")
    assert seen == ["uno"]  # a text's first chunk has no space before it


def test_tables_are_trimmed(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 8)
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(50):
        text = f"a b{i}, c{i} d{i}"
        assert ids(text) == ids._encode(text)
    assert len(ids.words) <= 8 and len(ids.chunks) <= 8 and "a" in ids.words
