"""Piece counts against greedy longest match, piece by piece."""

import random
import re
import time

import pyarrow as pa
import pytest

from folium.llm import wordpieces as w


def greedy(text, vocabulary):
    longest = max(map(len, vocabulary))
    total, words = 0, re.findall(rb"[^ \t-\r]+", (text or "").encode())
    for word in words:
        word = b" " + word
        while word:
            n = next(n for n in range(min(longest, len(word)), 0, -1) if word[:n] in vocabulary)
            word, total = word[n:], total + 1
    return len(words), total


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = set(w.spelt())
    want = {r["doc_id"]: greedy(r["text"], pieces) for r in df.collect()}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in w.token_counts(df).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies(seed):
    """Few letters and overlapping pieces, so that links go far."""
    rng = random.Random(seed)
    vocabulary = {bytes([b]) for b in range(256)} | {bytes(rng.choices(b" abc", k=rng.randint(2, 7))) for _ in range(40)}
    texts = ["".join(rng.choices("abc abc", k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "  ", "é中"]
    words, total = w.piece_counts(pa.array(texts), w.Automaton(sorted(vocabulary)))
    assert list(zip(words.tolist(), total.tolist())) == [greedy(t, vocabulary) for t in texts]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "", 4), (None, "a b", 5), (2, "x" * 100_000, 6)], "doc_id long, text string, n_words int")
    got = sorted(((r["doc_id"] or 0), r["n_words"]) for r in w.token_counts(df).collect())
    assert got == [(0, 2), (1, 0), (1, 0), (2, 1)]
    assert w.token_counts(df.where("false")).count() == 0


def test_long_words_among_many():
    """Work is linear: one word of 5 MB among 100,000 others, and hundreds of long ones, in seconds."""
    machine, rng = w.automaton(), random.Random(4)
    letters = rng.choices("etaoinshrdlu", k=1_000_000)
    blob = "".join(letters) * 5
    texts = [" ".join(f"w{i}" for i in range(100_000)) + " " + blob, " ".join(blob[i * 5000 : (i + 1) * 5000 - i] for i in range(300)), blob[:20_000]]
    began = time.process_time()
    words, total = w.piece_counts(pa.array(texts), machine)
    assert time.process_time() - began < 30
    assert words.tolist() == [100_001, 300, 1]
    pieces = set(w.spelt())
    assert greedy(texts[2], pieces)[1] == total[2] and greedy(texts[1][:40_000], pieces)[1] == w.piece_counts(pa.array([texts[1][:40_000]]), machine)[1][0]


def test_needs_all_bytes():
    with pytest.raises(ValueError):
        w.Automaton([b"a"])
