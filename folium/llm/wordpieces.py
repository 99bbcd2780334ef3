"""Token counts by a linear longest-match automaton over a vocabulary's trie.

Greedy word pieces of a word: the longest piece that starts it, then the longest that continues it, and so on. The trie
holds every piece; each node v has a failure link to the node of what remains once the longest pieces at v's start are
cut off, and the number of pieces so cut. One walk over a word's bytes then adds up those numbers: a byte either goes to
a child or pops pieces by the link, and no piece is ever built. The walk goes over all distinct words of a batch at once
as long as TOGETHER of them are left, then one by one, so the work is linear in the bytes however long a word is.

A byte-level vocabulary has a piece for every byte, so every word can be cut: a word is a run of bytes other than ASCII
white space, spelt with a space before it, as the vocabulary's word starts are.

Cases: a null text counts as empty; texts without words have no tokens; repeated rows and rows without doc_id each give
a row; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folium.llm.text import pieces, word_hashes
from folium.llm.tokens import _byte_letters, vocabulary

VOCABULARY = "byte_bpe_50k.json"
TOGETHER = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spelt(name: str = VOCABULARY) -> list[bytes]:
    """The pieces of a byte-level vocabulary, as bytes, without its special ones."""
    with open(vocabulary(name), encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model["added_tokens"]}
    letters = {c: b for b, c in _byte_letters().items()}
    return [bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


class Automaton:
    """The trie of pieces with failure links and the counts of popped pieces.

    children are kept as sorted keys node * 256 + byte, so a step for many walks is one binary search.
    """

    def __init__(self, vocabulary: list[bytes]):
        found: dict[int, int] = {}
        ends, parent, depth, letter = [False], [0], [0], [0]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in found:
                    found[key] = len(ends)
                    ends.append(False)
                    parent.append(node)
                    depth.append(depth[node] + 1)
                    letter.append(byte)
                node = found[key]
            ends[node] = node != 0
        if not all(b in found and ends[found[b]] for b in range(256)):
            raise ValueError("every single byte must be a piece")
        n = len(ends)
        link, pops = [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if ends[v]:
                link[v], pops[v] = 0, 1  # the whole of v is a piece; nothing remains
            else:
                at, popped = link[parent[v]], pops[parent[v]]
                while (at << 8 | letter[v]) not in found:
                    popped += pops[at]
                    at = link[at]
                link[v], pops[v] = found[at << 8 | letter[v]], popped
        self.found, self.steps = found, list(zip(link, pops, strict=True))
        keys = np.array(list(found), np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(found.values()), np.int64)[order]
        self.link, self.pops = np.array(link, np.int64), np.array(pops, np.int64)
        self.roots = np.zeros(256, np.int64)
        self.roots[self.keys[self.keys < 256]] = self.nodes[self.keys < 256]

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by its byte; -1 where there is none."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], -1)

    def walk(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after one word's bytes, and the pieces popped."""
        found, steps, total = self.found, self.steps, 0
        for byte in word:
            while (to := found.get(state << 8 | byte)) is None:
                state, n = steps[state]
                total += n
            state = to
        return state, total

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of " " + data[start:end] for each span."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still walking are a prefix
        starts, size = starts[order], (ends - starts)[order]
        state, total = np.full(len(starts), self.roots[32]), np.zeros(len(starts), np.int64)
        together = int(size[TOGETHER - 1]) if len(size) >= TOGETHER else 0  # bytes that so many words have
        walking = len(size) - np.cumsum(np.bincount(np.minimum(size, together), minlength=together + 1))
        for i in range(together):
            active = int(walking[i])
            todo, byte = np.arange(active), data[starts[:active] + i].astype(np.int64)
            while len(todo):
                at = state[todo]
                to = self.child(at, byte[todo])
                state[todo[to >= 0]] = to[to >= 0]
                todo, at = todo[to < 0], at[to < 0]
                total[todo] += self.pops[at]
                state[todo] = self.link[at]
        for j in range(min(TOGETHER, len(size))):
            if size[j] > together:
                state[j], more = self.walk(int(state[j]), data[starts[j] + together : starts[j] + size[j]].tobytes())
                total[j] += more
        left = np.flatnonzero(state)
        while len(left):
            total[left] += self.pops[state[left]]
            state[left] = self.link[state[left]]
            left = left[state[left] != 0]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


@lru_cache(2)
def automaton(name: str = VOCABULARY) -> Automaton:
    return Automaton(spelt(name))


def piece_counts(texts: pa.Array, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(words, pieces) of each text."""
    words, total = [], []
    for _, data, offsets in pieces(texts, most=8 << 20):
        inside = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        first = np.searchsorted(starts, offsets)
        _, one, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        n = machine.counts(data, starts[one], ends[one])[which]
        sums = np.concatenate([[0], np.cumsum(n)])
        words.append(np.diff(first))
        total.append(sums[first[1:]] - sums[first[:-1]])
    return (np.concatenate(words), np.concatenate(total)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def token_counts(documents: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each document; one pass, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(name)
        for batch in batches:
            words, tokens = piece_counts(batch["text"], machine)
            yield pa.record_batch([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")
