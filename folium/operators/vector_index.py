"""An inverted file of vectors: cells around fitted centres, searched exactly by bounds or by a fixed number of probes.

Centres are fitted on a bounded sample; every vector goes to the cell of its nearest centre and is stored with others of
that cell in chunks of bounded size, so a cell of any size is many rows. A cell's radius is the greatest distance of its
vectors from the centre; no product of a query q with them exceeds q * centre + |q| * radius. A search reads the best
cells of each query first, then all others whose bound reaches the n-th score found: so nothing is missed.
Vectors are added to the cells there are, without a new fit: only radii grow.

Vectors and queries that are null, of another length than the centres, or hold a null or non-finite component are left out
(vectors.audit_vectors reports them); such a query has no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.store import saved

#: Bounds of what a fit reads, of the number of cells, of a chunk's vectors and of the queries that meet one at once.
FIT_ROWS, MAX_CELLS, CHUNK, QUERIES = 32_768, 1024, 1024, 256
PROBES = 8


def sound(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there, with finite components only."""
    return df.where(F.size(column) > 0).where(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _distances(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it, a block of rows at a time."""
    cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    square = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        cell[at : at + 4096] = (square - 2 * part @ centres.T).argmin(1)
        far[at : at + 4096] = np.sqrt(((part - centres[cell[at : at + 4096]]) ** 2).sum(1))
    return cell, far


def fit_centres(vectors: DataFrame, cells: int | None = None, fit_rows: int = FIT_ROWS, rounds: int = 5) -> np.ndarray:
    """Centres by k-means on at most fit_rows vectors of the commonest length, those of the smallest hash; about the root of the number of vectors."""
    good = sound(vectors)
    common = good.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return np.zeros((0, 0))
    width, n = common["width"], common["n"]
    rows = good.where(F.size("embedding") == width).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(fit_rows).toArrow()
    x = np.unique(_matrix(rows["embedding"].combine_chunks(), width), axis=0)
    count = min(len(x), cells or max(1, min(MAX_CELLS, round(math.sqrt(n)))))
    centres = x[np.linspace(0, len(x) - 1, count).astype(int)]
    for _ in range(rounds):
        cell, _ = _distances(x, centres)
        size = np.bincount(cell, minlength=count)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class VectorIndex:
    """The index below a path: centres, chunks (cell, ids, flat), and the radius and size of cells as a log of additions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, fit_rows: int = FIT_ROWS) -> VectorIndex:
        index = cls(vectors.sparkSession, path)
        centres = fit_centres(vectors, cells, fit_rows)
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        index.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        index.add(vectors)
        return index

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(f"{self.path}/centres").orderBy("cell").collect()  # MAX_CELLS at most
        return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))

    def _chunks(self) -> DataFrame:
        return self.spark.read.schema("cell int, ids array<long>, flat array<double>").parquet(f"{self.path}/chunks")

    def radii(self) -> dict[int, float]:
        log = self.spark.read.schema("cell int, radius double, n long").parquet(f"{self.path}/cells")
        return {r["cell"]: r["radius"] for r in log.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}  # a row for each cell

    def add(self, vectors: DataFrame) -> None:
        """Puts vectors (vec_id, embedding) to their cells. Cells hold runs of vec_id, so a hot cell has many tasks.

        Radii are written before chunks, so a search never meets a vector beyond its cell's radius; an addition that failed
        between the two leaves radii that are too great, which costs reads but no hits, and may be run again.
        """
        centres = self.centres()
        width = centres.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, far = _distances(_matrix(batch["embedding"], width), centres)
                yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(far), batch["vec_id"], batch["embedding"]], ["cell", "far", "vec_id", "embedding"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, n = batch["cell"].to_numpy(), batch.num_rows
                cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), n] if n else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    for at in range(a, b, CHUNK):
                        part = batch.slice(at, min(CHUNK, b - at))
                        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                        yield pa.record_batch([part["cell"].slice(0, 1), whole(part["vec_id"]), whole(part["embedding"].flatten())], ["cell", "ids", "flat"])

        usable = sound(vectors).where(F.size("embedding") == width).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        assigned = saved(usable.mapInArrow(assign, "cell int, far double, vec_id long, embedding array<double>"), "assigned") if width else usable.select(F.lit(0).alias("cell"), F.lit(0.0).alias("far"), "*").limit(0)
        assigned.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{self.path}/cells")
        ordered = assigned.drop("far").repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id")
        ordered.mapInArrow(pack, "cell int, ids array<long>, flat array<double>").write.mode("append").parquet(f"{self.path}/chunks")

    def _products(self, pairs: DataFrame, n: int) -> DataFrame:
        """(query_id, vec_id, score) of pairs (query_id, q, least, cell): each chunk's n best that reach the query's least score."""
        size = pairs.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("m"))
        blocks = pairs.join(F.broadcast(size), "cell")  # a row for each cell, MAX_CELLS at most
        blocks = blocks.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("m")).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "least")).alias("qs"))

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qs, ids, flat in zip(batch["qs"], batch["ids"], batch["flat"], strict=True):
                    own = ids.values.to_numpy()
                    x = np.asarray(flat.values).reshape(len(own), -1)
                    qid, least = (np.asarray(qs.values.field(f)) for f in ("query_id", "least"))
                    q = _matrix(qs.values.field("q"), x.shape[1])
                    scores = np.round(q @ x.T, 10)
                    order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :n]
                    best = np.take_along_axis(scores, order, 1)
                    row, at = np.nonzero(best >= least[:, None])
                    yield pa.record_batch([pa.array(qid[row]), pa.array(own[order[row, at]]), pa.array(best[row, at])], ["query_id", "vec_id", "score"])

        met = blocks.join(self._chunks(), "cell").select("qs", "ids", "flat")
        return met.mapInArrow(products, "query_id long, vec_id long, score double")

    def nearest(self, queries: DataFrame, n: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """(query_id, vec_id, score, n): the n vectors of the greatest product with each query, ties by vec_id.

        exact: all cells that could hold one are read after the probes; else only the probes, the best cells by product
        with the centre.
        """
        from folium.operators.ranking import top

        centres, radii = self.centres(), self.radii()
        count, width = len(centres), centres.shape[1]
        order = [F.desc("score"), F.asc("vec_id")]
        if not count:
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, n int")
        radius = np.array([radii.get(i, -1.0) for i in range(count)])
        qs = saved(sound(queries).where(F.size("embedding") == width).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"), F.lit(float("-inf")).alias("least")), "queries")

        def cells(first: bool):
            def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 1024):
                        part = batch.slice(at, 1024)
                        q = _matrix(part["q"], width)
                        near = q @ centres.T
                        bound = np.where(radius >= 0, near + np.linalg.norm(q, axis=1)[:, None] * radius, -np.inf)
                        rank = np.argsort(np.argsort(np.where(radius >= 0, -near, np.inf), axis=1, kind="stable"), axis=1)
                        probed = (rank < probes) & (radius >= 0)
                        chosen = probed if first else ~probed & (radius >= 0) & (bound + 1e-9 * (1 + np.abs(bound)) >= np.asarray(part["least"])[:, None])
                        row, cell = np.nonzero(chosen)
                        yield pa.record_batch([part["query_id"].take(pa.array(row)), part["q"].take(pa.array(row)), part["least"].take(pa.array(row)), pa.array(cell, pa.int32())], ["query_id", "q", "least", "cell"])

            return choose

        schema = "query_id long, q array<double>, least double, cell int"
        found = saved(top(self._products(qs.mapInArrow(cells(True), schema), n), ["query_id"], order, n, "n"), "probed")
        if not exact:
            return found
        reached = found.where(F.col("n") == n).select("query_id", F.col("score").alias("reached"))
        again = qs.join(reached, "query_id", "left").select("query_id", "q", F.coalesce("reached", "least").alias("least"))
        more = self._products(again.mapInArrow(cells(False), schema), n)
        return top(found.drop("n").unionByName(more), ["query_id"], order, n, "n")

