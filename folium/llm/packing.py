"""Packing by minimum bin slack: whole documents' token ids into sequences of at most CAPACITY tokens.

A document longer than a sequence fills whole sequences first; what remains of each, under CAPACITY tokens, is packed.
A window is filled by the multiset of remaining lengths whose sum comes closest to the capacity: a subset-sum over
lengths is kept as bit sets (bit s of row i: sum s can be made of the first i lengths and their counts), and the counts
are read back from the rows. As long as no sum is exact, the window's last piece is cut to fill it, so that only the
end of a task's rows leaves a window open; it is cut at powers of two, which need no padding: up to 11 short sequences
for each task, against some 15,000 whole ones in a task of 128 MB.

Each task packs the rows that it reads, WINDOW_TOKENS at a time, without any shuffle. sequence_id is the task's number
times 2**33 plus a counter.

Cases: a null text is empty and holds the end id alone; rows with the same or no doc_id are packed row by row; other
columns are ignored; no row gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from folium.llm.tokens import END, encoded

CAPACITY = 2048
WINDOW_TOKENS = 4 << 20
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(stock: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) with the sum closest to capacity, from (length, count); no more is read once a sum is exact."""
    full, rows, lengths = (1 << (capacity + 1)) - 1, [1], []
    for length, count in stock:
        bits, left, part = rows[-1], min(count, capacity // length), 1
        while left:  # binary parts of the count
            take = min(part, left)
            bits |= (bits << (take * length)) & full
            left, part = left - take, part * 2
        rows.append(bits)
        lengths.append(length)
        if bits >> capacity & 1:
            break
    total, taken = rows[-1].bit_length() - 1, []
    for length, before in zip(reversed(lengths), reversed(rows[:-1]), strict=True):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            taken.append((length, n))
    return taken


class Packer:
    """Takes documents' ids and yields pieces (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, 0
        self.rest: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]  # by length: (document, start)

    def add(self, document: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        for start in range(0, n - n % self.capacity, self.capacity):
            yield document, start, self.capacity, self.sequence, 0
            self.sequence += 1
        if n % self.capacity:
            self.rest[n % self.capacity].append((document, n - n % self.capacity))

    def windows(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Packs what remains into full windows; less than one window stays."""
        tokens = sum(length * len(x) for length, x in enumerate(self.rest))
        longest = self.capacity - 1
        while tokens >= self.capacity:
            while not self.rest[longest]:
                longest -= 1
            room = self.capacity - longest
            stock = ((x, n) for x in range(min(longest, room), 0, -1) if (n := len(self.rest[x]) - (x == longest)) > 0)
            chosen = dict(fill(stock, room))
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(x * n for x, n in chosen.items())
            for _ in range(1 if slack else min(len(self.rest[x]) // n for x, n in chosen.items())):
                offset = 0
                for x in [x for x, n in chosen.items() for _ in range(n)]:
                    yield *self.rest[x].pop(), x, self.sequence, offset
                    offset += x
                while offset < self.capacity:  # no sum is exact: the next longest are cut to fill the window
                    x = next(x for x in range(self.capacity - 1, 0, -1) if self.rest[x])
                    document, start = self.rest[x].pop()
                    cut = min(self.capacity - offset, x)
                    yield document, start, cut, self.sequence, offset
                    offset += cut
                    if cut < x:
                        self.rest[x - cut].append((document, start + cut))
                        longest = max(longest, x - cut)
                self.sequence += 1
                tokens -= self.capacity

    def end(self) -> Iterator[tuple[int, int, int, int, int]]:
        """Packs the last, open window into sequences whose lengths are powers of two."""
        yield from self.windows()
        left = [(length, *x) for length in range(self.capacity - 1, 0, -1) for x in self.rest[length]]
        self.rest = [[] for _ in range(self.capacity)]
        tokens, room, offset = sum(x[0] for x in left), 0, 0
        for length, document, start in left:
            while length:
                if not room:
                    room, offset = 1 << (tokens.bit_length() - 1), 0
                cut = min(room, length)
                yield document, start, cut, self.sequence, offset
                offset, room, length, start, tokens = offset + cut, room - cut, length - cut, start + cut, tokens - cut
                if not room:
                    self.sequence += 1


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """The pieces of documents' token ids, by SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(capacity), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        ids: dict[int, bytes] = {}  # of documents with pieces to come
        names: dict[int, int | None] = {}
        left: dict[int, int] = {}  # tokens of them that have no piece yet
        n, waiting = 0, 0

        def rows(pieces: Iterator[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
            out = []
            for document, start, length, sequence, offset in pieces:
                own = ids[document]
                out.append((names[document], start, length, zlib.crc32(memoryview(own)[4 * start : 4 * (start + length)]), len(own) // 4, base + sequence, offset))
                left[document] -= length
                if not left[document]:
                    del ids[document], names[document], left[document]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def whole(new: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
            for document in new:
                yield from packer.add(document, len(ids[document]) // 4)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                new = []
                all_, bounds = encoded(part["text"], vocabulary, end)
                for i, name in enumerate(part["doc_id"].to_pylist()):
                    own = all_[bounds[i] : bounds[i + 1]].tobytes()
                    ids[n], names[n], left[n] = own, name, len(own) // 4
                    waiting += len(own) // 4
                    new.append(n)
                    n += 1
                yield from rows(whole(new))
                if waiting >= window_tokens:
                    yield from rows(packer.windows())
                    waiting = 0
        yield from rows(packer.end())

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
