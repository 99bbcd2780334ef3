"""Whole texts as numpy arrays: words, word hashes and distinct word shingles of many documents at once.

A word is a maximal run of ASCII letters and digits and of bytes above 127 in the lower-cased UTF-8 text, so
punctuation, white space and case never matter. Nothing here is cut or capped: a batch is split between documents
only, and one long document makes one large piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
PIECE_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        one = np.uint64(1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[one], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def pieces(texts: pa.Array | pa.ChunkedArray, lower: bool = False, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `most` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(texts), row + 60_000)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (one more entry than documents)."""
    inside = _WORD[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by prefix sums of one polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(words: np.ndarray, first: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 48-bit shingle, times it occurs there), sorted, for every distinct run of k words of each document.

    A document of fewer than k words has one shingle of all its words; one without words has none.
    """
    n = np.diff(first)
    step = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(k - 1, _STEP, np.uint64)]))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    left = np.repeat(np.where(n >= k, k, n), count)
    hashes = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = left < k
    for j in range(k):
        part = padded[at + j] * step[j]
        if j:
            part[short & (left <= j)] = 0
        hashes += part
    keys = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (mix(hashes) >> np.uint64(16)))
    if not len(keys):
        return doc, keys, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    kept = keys[new]
    return (kept >> np.uint64(48)).astype(np.int64), kept & np.uint64((1 << 48) - 1), np.diff(np.append(new, len(keys)))


def shingled(texts: pa.Array, k: int = SHINGLE_WORDS, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, document, shingle, times) of each piece of texts."""
    for row, data, offsets in pieces(texts, lower=True, most=most):
        starts, ends, first = word_spans(data, offsets)
        yield row, len(offsets) - 1, *shingles(word_hashes(data, starts, ends), first, k)
