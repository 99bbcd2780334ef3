"""Vector code compression: each part of a vector as the index of its nearest codebook entry, found by slices of masks.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that starts as that
part of the first kept vectors and is refitted for some rounds over all vectors. The nearest entry is exact: every
dimension's entry coordinates lie sorted, with the set of entries up to each place as a bitmask. The nearest of a few
entries that are close in one dimension gives a radius within which the nearest of all must lie; the radius picks a slice
of each dimension, whose mask is the difference of two prefix masks; the slices' masks and-ed are the candidates, and only
those are measured, as far as their partial sums stay within the radius.

Rounds bring sums by entry to the driver, of entries x dimensions numbers, whatever the number of vectors.

Cases: rows whose vector is null or holds a null or non-finite component are dropped. Vectors of another length than the
first kept one are never learnt from and get a null code and error. Repeated rows each count and each give a row; rows of
one vec_id are ordered by vector, those without vec_id come last. Fewer vectors than entries give as many entries as there
are vectors. A length that isn't a multiple of the parts is cut at floor(i * length / parts). Components are held within
+-2**30 / sqrt(length), which keeps every sum of squares inside 64 bits. Other columns of any name pass through codes(); ones named
code or error give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from folium.sources.store import saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 2048  # vectors whose candidates are held at once
HOT_SHARE = 1000  # a label is hot from this fraction of all rows on; so there are at most as many hot labels


class Slices:
    """One part position's entries with their sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, self.width = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.coordinates = np.take_along_axis(entries.T, self.order, 1)
        bits = np.zeros((self.width, count + 1, -(-count // 64)), np.uint64)
        for d, order in enumerate(self.order):
            bits[d, np.arange(1, count + 1), order // 64] = np.uint64(1) << (order % 64).astype(np.uint64)
        self.prefix = np.bitwise_or.accumulate(bits, axis=1)

    def masks(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bits of the entries within radius of x in every dimension."""
        out = np.full((len(x), self.prefix.shape[2]), ~np.uint64(0))
        for d in range(self.width):
            low = np.searchsorted(self.coordinates[d], x[:, d] - radius, "left")
            high = np.searchsorted(self.coordinates[d], x[:, d] + radius, "right")
            out &= self.prefix[d, high] & ~self.prefix[d, low]
        return out

    def bound(self, x: np.ndarray) -> np.ndarray:
        """The least squared distance to the entries next to x in one dimension or another: no less than the least of all."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(self.width):
            at = np.minimum(np.searchsorted(self.coordinates[d], x[:, d]), len(self.entries) - 1)
            least = np.minimum(least, ((x - self.entries[self.order[d, at]]) ** 2).sum(1))
        return least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, the lower index of equally near ones."""
        if not self.width:
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            most = self.bound(part)
            radius = np.sqrt(most.astype(np.float64)).astype(np.int64) + 1  # one more than the root, whatever its rounding
            held = np.unpackbits(self.masks(part, radius).view(np.uint8), axis=1, bitorder="little")[:, : len(self.entries)]
            row, entry = np.nonzero(held)
            total = np.zeros(len(row), np.int64)
            for d in range(0, self.width, 4):
                total += ((part[row, d : d + 4] - self.entries[entry, d : d + 4]) ** 2).sum(1)
                near = total <= most[row]
                row, entry, total = row[near], entry[near], total[near]
            first = np.searchsorted(row, np.arange(len(part)))  # rows ascend, entries ascend in a row; each row has one at least
            least = np.minimum.reduceat(total, first)
            best = np.flatnonzero(total == least[row])
            best = best[np.searchsorted(row[best], np.arange(len(part)))]
            index[at : at + ROWS], distance[at : at + ROWS] = entry[best], total[best]
        return index, distance


@dataclass
class Codebooks:
    """books[p] holds the entries of part p."""

    books: list[np.ndarray]
    length: int
    scale: int

    @cached_property
    def slices(self) -> list[Slices]:
        return [Slices(b) for b in self.books]

    def integers(self, vectors: np.ndarray) -> np.ndarray:
        most = math.isqrt((1 << 60) // max(1, self.length))
        return np.floor(np.clip(vectors.astype(np.float64) * self.scale, -most, most)).astype(np.int64)

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return np.split(self.integers(vectors), np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of this length as a matrix, and which rows they are."""
        size = np.asarray(column.value_lengths())
        fits = np.flatnonzero(size == self.length)
        return np.asarray(column.take(pa.array(fits)).flatten(), np.float64).reshape(len(fits), self.length), fits

    def listed(self) -> str:
        """All components by part, entry and position."""
        return ",".join(map(str, np.concatenate([b.ravel() for b in self.books]).tolist())) if self.books else ""


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector and components are all there and finite."""
    x = F.col(column)
    return vectors.where(x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False)))


def _first(vectors: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    length = len(rows[0]["v"]) if rows else 0
    books = Codebooks([np.zeros((0, length), np.int64)], length, scale)
    if rows:
        x = books.integers(np.array([r["v"] for r in rows if len(r["v"]) == length]).reshape(-1, length))
        books.books = np.split(x, [length * i // parts for i in range(1, parts)], axis=1)
    return books


def _refitted(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry as the mean, rounded down, of the parts nearest to it; an entry without any stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [np.zeros_like(b) for b in books.books], [np.zeros(len(b), np.int64) for b in books.books]
        for batch in batches:
            x, _ = books.rows(batch["embedding"])
            for p, part in enumerate(books.parts(x)):
                index, _ = books.slices[p].nearest(part)
                np.add.at(total[p], index, part)
                n[p] += np.bincount(index, minlength=len(n[p]))
        for p, (t, count) in enumerate(zip(total, n, strict=True)):
            used = np.flatnonzero(count)
            if len(used) and t.shape[1]:
                entry, at = np.repeat(used, t.shape[1]), np.tile(np.arange(t.shape[1]), len(used))
                yield pa.record_batch([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(at), pa.array(t[used].ravel()), pa.array(count[entry])], ["part", "entry", "at", "total", "n"])

    each = vectors.select("embedding").mapInArrow(sums, "part long, entry long, at long, total long, n long")
    rows = each.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # entries x dimensions at most
    new = [b.copy() for b in books.books]
    for r in rows:
        new[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return Codebooks(new, books.length, books.scale)


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of vectors (vec_id, embedding), refitted over all of them in each round."""
    rows = kept(vectors)
    books = _first(rows, parts, entries, scale)
    for _ in range(rounds if books.length else 0):
        books = _refitted(rows, books)
    return books


def codes(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The kept rows of vectors with code (an entry of each part) and error (the squared distances summed)."""
    rows = kept(vectors).drop("code", "error")
    whole = rows.select(F.struct("*").alias("row"), F.col("embedding").cast("array<double>").alias("x"))
    schema = StructType([whole.schema["row"], StructField("code", ArrayType(IntegerType())), StructField("error", LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fits = books.rows(batch["x"])
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            if books.length and len(x):
                found = [s.nearest(p) for s, p in zip(books.slices, books.parts(x), strict=True)]
                for at, c, e in zip(fits.tolist(), np.column_stack([f[0] for f in found]).tolist(), sum(f[1] for f in found).tolist(), strict=True):
                    code[at], error[at] = c, e
            yield pa.record_batch([batch["row"], pa.array(code, pa.list_(pa.int32())), pa.array(error, pa.int64())], ["row", "code", "error"])

    return whole.mapInArrow(encode, schema).select("row.*", "code", "error")


def with_group_error(coded: DataFrame, by: str = "label") -> DataFrame:
    """coded with group_error: error summed over rows of equal `by`, nulls together; null beyond 64 bits.

    Groups of at least a HOT_SHARE-th of all rows, at most HOT_SHARE of them, are joined by broadcast, so that no task
    gets a hot group; the others by a join on equal keys.
    """
    rows = saved(coded, "codes")
    total = saved(rows.groupBy(by).agg(F.try_sum("error").alias("group_error"), F.count("*").alias("_n")), "group-errors")
    n = rows.count()
    hot, cold = (total.where(F.col("_n") * HOT_SHARE >= n if first else F.col("_n") * HOT_SHARE < n).select(F.col(by).alias("_by"), "group_error") for first in (True, False))
    one = rows.join(F.broadcast(hot), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    same = lambda t: F.col(by).eqNullSafe(F.col("_by"))
    two = rows.join(F.broadcast(hot.select("_by")), same(hot), "left_anti").join(cold, same(cold)).drop("_by")
    return one.unionByName(two)
