"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of the words of a window and ignores the others, so a passage with substituted words still agrees in
windows whose changed words fall on ignored places. Hashes of masked test windows and of masked training windows are
joined; around the hits the whole test item is laid over the document, without gaps, and the words that agree are
counted. An item is found where at least SHARE of its words agree, and at least LEAST_WORDS of them (all, in a shorter
item), or where LOCAL_WORDS of some LOCAL_SPAN words in a row agree: a passage that is cut off, quoted in part or parted
by a dropped line is found by what is left of it, at the place of each part. matched_words counts the whole overlay.

No such overlay is missed. A mask reads three words within `widest` + 1 of each other, and all such masks are used. Where
m of n words agree, each agreeing word but the last two begins a window up to the second agreeing word after it; these
m - 2 windows together are at most 2 * (n - 1) places wide and none is narrower than two, so at least
((widest + 1) * (m - 2) - 2 * (n - 1)) / (widest - 1) of them are read by a mask. Only overlays with that many hits
are laid, so a few frequent words in common cost no more than the hit. `widest` is 5 and leaves two hits at least for
any item at a SHARE of 0.5; a smaller share takes a greater one. Items of fewer than LEAST_WORDS words must agree in all
and are read whole; those of fewer than LINE_WORDS words say too little to be looked for inside a line and are found
where they are all words of a line.

Test windows go to every task, in blocks of items of about BLOCK_WORDS words, and are joined there: a block meets each
document once, whatever the size of the benchmark, and no document moves. Where there are several blocks, one's hits are
written before the next goes out, so that one is held at a time.

Cases: null texts count as empty; items without words, or without item_id, find nothing; documents shorter than an item
by up to 1 - SHARE of its words can still hold it at their start or end; rows without doc_id are never reported and never
removed; repeated rows are reported once, and several texts of one doc_id or item_id each on their own; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.text import pieces, word_hashes, word_spans
from folium.sources.store import saved

LINE_WORDS = 5
LEAST_WORDS = 8
SHARE = 0.5
#: Chance runs of agreeing words reach 5 to 7.
LOCAL_WORDS, LOCAL_SPAN = 8, 10
WIDEST = 5
BLOCK_WORDS = 500_000
HITS = 4_000_000  # pairs of windows that are looked at together, but for one document's
_HITS = "doc_id long, item_id long, start_word int, matched_words int, item_words int"
_COEFFICIENTS = np.multiply.accumulate(np.full(64, 0xD1342543DE82EF95, np.uint64))


def _masks(widest: int) -> list[tuple[int, ...]]:
    """The places that each mask reads: 111, 1101, 1011, 11001, 10101, 10011 and so on."""
    return [(0, middle, last) for last in range(2, widest + 1) for middle in range(1, last)]


def _widest(n: np.ndarray, needed: np.ndarray) -> int:
    """How wide masks must be so that every item of n words of which `needed` agree has a hit."""
    long = n >= LEAST_WORDS
    return int(max(WIDEST, (2 * (n[long] - 1) // (needed[long] - 2)).max(initial=0)))


def _least_hits(n: np.ndarray, needed: np.ndarray, widest: int) -> np.ndarray:
    """The hits that an overlay has at least where it agrees in `needed` words, or in LOCAL_WORDS of LOCAL_SPAN."""
    least = lambda m, n: -(((widest + 1) * (m - 2) - 2 * (n - 1)) // (1 - widest))
    return np.where(n < LEAST_WORDS, 1, np.minimum(least(needed, n), least(LOCAL_WORDS, LOCAL_SPAN)))


def _windows(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """The masked hash of every window of words; it ends with the last word that is read."""
    n, number = len(words) - places[-1], sum(place << 6 * j for j, place in enumerate(places)) * 0x632BE59BD9B4E019 & (1 << 64) - 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, number, np.uint64)
    for j, p in enumerate(places):
        out += words[p : p + n] * _COEFFICIENTS[j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's first word."""
    hashes, first = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, data, offsets in pieces(texts, lower=True):
        starts, ends, own = word_spans(data, offsets)
        hashes.append(word_hashes(data, starts, ends))
        first.append(own[1:] + first[-1][-1])
    return np.concatenate(hashes), np.concatenate(first)


def _needed(n: np.ndarray, share: float) -> np.ndarray:
    return np.maximum(np.ceil(n * share - 1e-9), np.minimum(n, LEAST_WORDS)).astype(np.int64)


class _Items:
    """Test items with their masked windows, sorted by hash; share is the least that find() can be asked for."""

    def __init__(self, ids: list[int], texts: pa.Array, share: float = SHARE):
        self.words, self.first = _words(texts)
        self.size, self.ids = np.diff(self.first), np.array(ids, np.int64)
        needed = _needed(self.size, share)
        widest = _widest(self.size, needed)
        self.least = _least_hits(self.size, needed, widest)
        spaced, whole = _masks(widest), [tuple(range(n)) for n in np.unique(self.size[(self.size > 0) & (self.size < LEAST_WORDS)]).tolist()]
        self.masks = [*spaced, *(mask for mask in whole if mask not in spaced)]
        item = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(self.words)) - self.first[item]
        parts = []
        for mask in self.masks:
            h = _windows(self.words, mask)
            own, at = item[: len(h)], place[: len(h)]
            n = self.size[own]
            inside = (at + mask[-1] < n) & ((n >= LEAST_WORDS) & (mask in spaced) | (n == len(mask)) & (mask in whole))
            parts.append((h[inside], own[inside].astype(np.int32), at[inside].astype(np.int32)))
        keys, own, at = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], own[order], at[order]
        bits = min(26, max(20, len(self.keys).bit_length() + 3))
        self.seen, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.seen[self.keys >> self.shift] = True

    def _hits(self, words: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of each mask the (place, document, first key, keys, place of its last word) of the windows that items have too."""
        out = []
        for mask in self.masks:
            h = _windows(words, mask)
            at = np.flatnonzero(self.seen[h >> self.shift])
            lo = np.searchsorted(self.keys, h[at])
            n = np.searchsorted(self.keys, h[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + mask[-1] < first[doc + 1]
            out.append((at[inside], doc[inside], lo[inside], n[inside], mask[-1]))
        return out

    def _overlays(self, words: np.ndarray, first: np.ndarray, lines: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, start) of overlays with hits enough, for some documents at a time."""
        hits, documents, reach = self._hits(words, first), len(first) - 1, int(self.size.max(initial=0))
        total = sum(np.bincount(doc, n, documents) for _, doc, _, n, _ in hits)
        cuts = np.flatnonzero(np.diff(np.cumsum(total) // HITS)) + 1
        # Documents are set apart by the longest item, so that an overlay over an edge has a place of its own.
        lowest = first[:-1] + np.arange(documents) * reach - reach + 1
        width = len(words) + (documents + 1) * reach
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), documents]):
            parts = []
            for at, doc, lo, n, last in hits:
                own = slice(*np.searchsorted(doc, [a, b]))
                at, doc, lo, n = at[own], doc[own], lo[own], n[own]
                for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
                    m = n[cut]
                    hit = np.repeat(lo[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    item = self.item[hit].astype(np.int64)
                    key = item * width + np.repeat(at[cut] + doc[cut] * reach + reach, m) - self.at[hit]
                    short = np.flatnonzero(self.size[item] < LINE_WORDS)
                    if len(short):
                        begin = np.repeat(at[cut], m)[short]
                        key = np.delete(key, short[~(np.isin(begin, lines) & np.isin(begin + last + 1, lines))])
                    parts.append(np.unique(key, return_counts=True))
            key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            hits_of = np.bincount(where, np.concatenate([c for _, c in parts]), len(key))
            key = key[hits_of >= self.least[key // width]]
            start = key % width - reach
            doc = np.searchsorted(lowest, start, "right") - 1
            yield doc, key // width, start - doc * reach
    def find(self, words: np.ndarray, first: np.ndarray, lines: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
        """(document, item, start, matched) of each item found at each place; lines are words that begin one, and the end."""
        found = [np.zeros((4, 0), np.int64)]
        for doc, item, start in self._overlays(words, first, lines) if len(self.keys) else ():
            matched, near, most = (np.zeros(len(doc), np.int64) for _ in range(3))
            last = np.zeros((LOCAL_SPAN, len(doc)), bool)
            for k in range(int(self.size[item].max()) if len(item) else 0):
                on = (k < self.size[item]) & (start + k >= first[doc]) & (start + k < first[doc + 1])
                same = np.zeros(len(doc), bool)
                same[on] = words[start[on] + k] == self.words[self.first[item[on]] + k]
                matched += same
                near += same.astype(np.int64) - last[k % LOCAL_SPAN]
                last[k % LOCAL_SPAN] = same
                np.maximum(most, near, out=most)
            kept = (matched >= _needed(self.size[item], share)) | (most >= LOCAL_WORDS)
            found.append(np.stack([doc[kept], item[kept], start[kept] - first[doc[kept]], matched[kept]]))
        return tuple(np.concatenate(found, 1))


def _searched(documents: DataFrame, shared: Broadcast, share: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for row, data, offsets in pieces(batch["text"], lower=True):
                starts, ends, first = word_spans(data, offsets)
                lines = np.unique(np.concatenate([first, np.searchsorted(starts, np.flatnonzero(data == 10))]))
                doc, item, start, matched = own.find(word_hashes(data, starts, ends), first, lines, share)
                if len(doc):
                    yield pa.record_batch(
                        [pa.array(ids[row + doc], pa.int64()), pa.array(own.ids[item]), pa.array(start, pa.int32()), pa.array(matched, pa.int32()), pa.array(own.size[item], pa.int32())],
                        ["doc_id", "item_id", "start_word", "matched_words", "item_words"],
                    )

    return documents.mapInArrow(search, _HITS)


def contaminated(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, matched_words, item_words, overlap) of each item found at each place."""
    documents = documents.select("doc_id", "text").where("doc_id is not null")
    items = benchmark.select("item_id", F.col("text").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / (2 * block_words)))  # a word takes two bytes at least, with what parts it from the next
    block = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = items.where(block == b).orderBy("item_id", "item_text").toArrow()
        shared = documents.sparkSession.sparkContext.broadcast(_Items(rows["item_id"].to_pylist(), rows["item_text"], share))
        found.append(_searched(documents, shared, share))
        if blocks > 1:
            found[-1] = saved(found[-1], "benchmark-hits")
            shared.destroy()
    return functools.reduce(DataFrame.unionByName, found).distinct().withColumn("overlap", F.col("matched_words") / F.col("item_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """documents without those that hold a test item."""
    hits = contaminated(documents, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return documents.join(hits, documents["doc_id"] == hits["_hit"], "left_anti")
