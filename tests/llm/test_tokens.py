"""Cached encoding against the library's own on real and odd texts."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folium.llm import tokens

NAMES = list(tokens.PATTERNS)


def library(name, text):
    return tokens.encoder(name).whole.encode(text, add_special_tokens=False).ids


def same(name, texts):
    ids, bounds = tokens.encoded(texts, name)
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(ids)
    for i, text in enumerate(texts.to_pylist()):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*library(name, text or ""), 1], text


@pytest.mark.parametrize("name", NAMES)
def test_table(name, sf):
    texts = pq.read_table(f"{sf}/documents.parquet")["text"]
    same(name, texts)


@pytest.mark.parametrize("name", NAMES)
@given(st.text(st.sampled_from("ab Z é'sß.,\n\n\t 0٣9<|>́ \x1c中Σİ_-"), max_size=30))
@settings(max_examples=600, deadline=None)
def test_odd_texts(name, text):
    assert np.frombuffer(tokens.encoder(name).encode(text), "<u4").tolist() == library(name, text)


LETTERS = "ab Z é'sßĳ.,\n\n\t 09<|retvmlLSDſȺȾ_-×÷İ中\x7f"


@pytest.mark.parametrize("name", NAMES)
@given(st.lists(st.text(st.sampled_from(LETTERS), max_size=30), max_size=12))
@settings(max_examples=1500, deadline=None)
def test_odd_batches(name, texts):
    """Plain texts side by side with others, split at their pieces at once."""
    same(name, pa.array(texts, pa.string()))


@pytest.mark.parametrize("name", NAMES)
def test_long_texts_and_slices(name):
    texts = pa.array([None, "It's  a test.\n" * 60_000, "", "é" * 300_000, "x", "中 " * 1000, "end 's 're\n\n  "])
    same(name, texts)
    same(name, texts.slice(2, 4))
    same(name, texts.slice(0, 0))


def test_table_starts_anew():
    e = tokens.Encoder(NAMES[0])
    e.table_ = tokens.PieceTable(e, bits=4, store=20)
    text = " ".join(f"word{i % 37}a" for i in range(500))
    data = np.frombuffer(text.encode(), np.uint8)
    for _ in range(3):
        ids, size = e.table_.lookup(data, *tokens.split(data, np.array([0, len(data)]), False))
        assert ids.tolist() == e.whole.encode(text, add_special_tokens=False).ids and size.sum() == len(ids)
    assert len(e.table_.keys) == 16


@pytest.mark.parametrize("name", NAMES)
def test_special_strings_and_null(name):
    for text in ("a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|>  y", "  a", "a  b", "a \n b", "é é", ""):
        assert np.frombuffer(tokens.encoder(name).encode(text), "<u4").tolist() == library(name, text)
    ids, bounds = tokens.encoded(pa.array([None, ""]), name)
    assert ids.tolist() == [1, 1] and bounds.tolist() == [0, 1, 2]


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    e = tokens.Encoder(NAMES[0])
    text = " ".join(f"word{i % 7}" for i in range(50))
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids
    assert len(e.new) <= 4 and len(e.old) <= 4
