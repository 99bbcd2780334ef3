"""Vector records: validation, normal form, work lists, states, and user-supplied encoders (V1-V6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """V1: (vec_id, error) of vectors of another dimension, with values that aren't finite, without length, or with a bad or repeated id."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("_n", F.count("*").over(Window.partitionBy("vec_id")))
    error = F.when(F.col("vec_id").isNull() | (F.col("vec_id") < 0), "id").when(F.col("_n") > 1, "repeated").when(F.coalesce(F.size("embedding"), F.lit(-1)) != dimension, "dimension").when(~finite, "not_finite").when(norm == 0, "zero")
    return rows.select("vec_id", error.alias("error")).where("error is not null")


def l2_normalize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """V2: vectors of length one; a zero vector stays."""
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("_length", length).withColumn(column, F.when(F.col("_length") > 0, F.transform(column, lambda x: x.cast("double") / F.col("_length"))).otherwise(F.col(column).cast("array<double>"))).drop("_length")


def embedding_worklist(papers: DataFrame, records: DataFrame, index: str) -> DataFrame:
    """V3: papers (paper_id, text_hash) with work: reuse an active record of the text, wait for a pending one, else encode."""
    own = records.where((F.col("index_name") == index) & F.col("status").isin("active", "pending")).groupBy("paper_id", "text_hash").agg(F.max(F.col("status") == "active").alias("_active"))
    rows = papers.join(own, ["paper_id", "text_hash"], "left")
    return rows.withColumn("work", F.when(F.col("_active"), "reuse").when(F.col("_active").isNotNull(), "wait").otherwise("encode")).drop("_active")


def apply_transitions(log: DataFrame) -> DataFrame:
    """V4: each record's state after a log (index_name, paper_id, vec_id, seq, event: reserve, activate, fail).

    Activating a record retires the one of its paper that was active before.
    """
    last = log.groupBy("index_name", "paper_id", "vec_id").agg(F.max_by("event", "seq").alias("event"), F.max(F.when(F.col("event") == "activate", F.col("seq"))).alias("activated"))
    newest = F.max(F.when(F.col("event") == "activate", F.col("activated"))).over(Window.partitionBy("index_name", "paper_id"))
    state = F.when(F.col("event") == "fail", "failed").when(F.col("event") == "reserve", "pending").when(F.col("activated") == newest, "active").otherwise("inactive")
    return last.select("index_name", "paper_id", "vec_id", state.alias("status"))


def index_metadata(records: DataFrame) -> DataFrame:
    """V5: (index_name, n_active, dimension, n_dimensions) of active records."""
    return records.where("status = 'active'").groupBy("index_name").agg(F.count("*").alias("n_active"), F.max(F.size("embedding")).alias("dimension"), F.count_distinct(F.size("embedding")).alias("n_dimensions"))


def _halving(fn: Callable, items: list, size: int) -> list:
    """fn over batches; a batch that runs out of memory is tried once more in halves; one of another length is left null."""
    out: list = []
    for at in range(0, len(items), size):
        batch = items[at : at + size]
        try:
            found = list(fn(batch))
        except MemoryError:
            half = max(1, len(batch) // 2)
            found = [x for part in (batch[:half], batch[half:]) if part for x in fn(part)]
        out += found if len(found) == len(batch) else [None] * len(batch)
    return out


def encode(df: DataFrame, load: Callable[[], Callable], column: str = "text", out: str = "embedding", size: int = 4) -> DataFrame:
    """V6: df with vectors of a text column; load() runs once for each task and returns the encoder of a list of texts.

    A batch for which it returns another number of vectors has none, so that ranking falls back to R2 for them.
    """
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"{out} array<double>"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for frame in frames:
            frame[out] = [None if v is None else list(map(float, v)) for v in _halving(fn, frame[column].fillna("").tolist(), size)]
            yield frame

    return df.mapInPandas(run, schema)


def score_pairs(df: DataFrame, load: Callable[[], Callable], left: str, right: str, out: str = "pair_score", size: int = 16) -> DataFrame:
    """V6: df with the score of each pair of texts."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"{out} double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for frame in frames:
            frame[out] = [None if x is None else float(x) for x in _halving(fn, list(zip(frame[left].fillna(""), frame[right].fillna(""))), size)]
            yield frame

    return df.mapInPandas(run, schema)


def hashing_encoder(dimension: int = 16) -> Callable[[], Callable]:
    """A small encoder for tests: counts of words by their hash."""

    def load() -> Callable:
        import zlib

        def fn(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                row = [0.0] * dimension
                for word in text.split():
                    row[zlib.crc32(word.encode()) % dimension] += 1
                out.append(row)
            return out

        return fn

    return load
