"""Periodic runs: stretches of words that repeat a period several times, found by a dictionary of basic factors.

A word is a maximal stretch of other characters than ASCII white space. A factor of 2**k words gets a name by the pair of
names of its halves; only factors that occur twice in their document are named, since no longer factor over one that
occurs once can come again. At each length m, an occurrence whose successor is at most 2m words on proposes that distance
as a period. Neighbouring occurrences of one distance are an arithmetic progression and propose once; the proposal is
extended to both sides by names, from the longest length down, and what is long enough is a run. One stretch proposed
with several periods keeps the smallest.

Nothing is missed: inside a run of smallest period q, factors of q words or more come again exactly q words later, so a
run of at least 4q words proposes q at the length m with q <= m < 2q.

Work is that of sorting for each length, and lengths end where no factor comes twice. A document is worked on in one
task, many of a batch together; nothing is shuffled.

Cases: a null text has no words and an empty collapsed text; repeated rows, rows without doc_id and very long texts are
like all others; other columns, of any name, pass through, but for one named runs or n_words, which gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folium.llm.text import pieces, word_hashes

LEAST_WORDS, LEAST_PERIODS = 6, 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each document's first word (one more entry than documents)."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def _named(at: np.ndarray, *keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the places `at` by their keys, -1 for all others and for keys that come once; also, for each named place
    that has a later one of its name, that place and the distance to the next."""
    order = np.lexsort((at, *keys))
    place = at[order]
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] = same
    twice[:-1] |= same
    name = np.cumsum(np.concatenate([np.zeros(min(len(at), 1), bool), ~same]))
    out = np.full(size, -1, np.int32)
    out[place[twice]] = name[twice]
    return out, place[:-1][same], np.diff(place)[same]


class Factors:
    """Names of the repeated factors of 1, 2, 4, ... words of many documents, and the distances that they propose."""

    def __init__(self, word: np.ndarray, first: np.ndarray):
        n = len(word)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][doc]
        self.names, self.proposed = [], []
        at, keys = np.arange(n), (word, doc)
        while len(at):
            m = 1 << len(self.names)
            name, place, step = _named(at, *keys, size=n)
            if not len(place):
                break
            self.names.append(name)
            near = step <= 2 * m
            self.proposed.append((place[near], step[near]))
            at = np.flatnonzero(name >= 0)
            at = at[at + 2 * m <= self.end[at]]
            at = at[name[at + m] >= 0]
            keys = (name[at + m], name[at])

    def match(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from a on equal those from b on (back: those before a and before b), all in one document."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, m = self.names[k], 1 << k
            while True:
                x, y = (a - m, b - m) if back else (a, b)
                ok = (x >= 0) & (y >= 0) & (x < len(name)) & (y < len(name))
                own = name[np.where(ok, x, 0)]
                ok &= (own >= 0) & (own == name[np.where(ok, y, 0)])
                if not ok.any():
                    break
                step = np.where(ok, -m if back else m, 0)
                a, b, total = a + step, b + step, total + np.where(ok, m, 0)
                if k < len(self.names) - 1:
                    break  # two of these would have been one of the length above

        return total

    def runs(self, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of each run, by start and period."""
        found = []
        for place, step in self.proposed:
            order = np.lexsort((place, step))
            place, step = place[order], step[order]
            head = np.ones(len(place), bool)
            head[1:] = (step[1:] != step[:-1]) | (place[1:] != place[:-1] + 1)
            place, step = place[head], step[head]
            start = place - self.match(place, place + step, back=True)
            end = place + step + self.match(place, place + step)
            long = end - start >= np.maximum(least, periods * step)
            found.append(np.stack([start[long], end[long], step[long]]))
        start, end, period = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def collapsed(texts: pa.Array, least: int, periods: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    """For each text its number of words, its runs and its words without those that only repeat."""
    counts, runs, out = [], [], []
    for _, data, offsets in pieces(texts):
        starts, ends, first = words(data, offsets)
        start, end, period = Factors(word_hashes(data, starts, ends), first).runs(least, periods)
        covered = np.zeros(len(starts) + 1, np.int64)
        np.add.at(covered, start + period, 1)
        np.add.at(covered, end, -1)
        keep = np.cumsum(covered[:-1]) == 0
        bounds = np.searchsorted(start, first)
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            text = raw[offsets[i] : offsets[i + 1]].split()
            x, y = bounds[i], bounds[i + 1]
            counts.append(b - a)
            runs.append([{"start": s - a, "length": e - s, "period": p} for s, e, p in zip(start[x:y].tolist(), end[x:y].tolist(), period[x:y].tolist(), strict=True)])
            out.append(b" ".join(text if x == y else compress(text, keep[a:b].tolist())))
    return counts, runs, out


def collapse(documents: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """documents with n_words and runs (start, length, period, in words), whose text keeps of each run its first period
    and is joined by single spaces. A run has at least `least` words and at least `periods` periods (4 or more)."""
    if periods < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")
    rows = documents.drop("runs", "n_words")
    whole = rows.select(F.struct("*").alias("row"), "text")
    schema = StructType([whole.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("kept", StringType())])
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = collapsed(batch["text"], least, periods)
            yield pa.record_batch([batch["row"], pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "kept"])

    return whole.mapInArrow(work, schema).select(F.col("row").withField("text", F.col("kept")).alias("row"), "n_words", "runs").select("row.*", "n_words", "runs")
