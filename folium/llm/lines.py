"""Line dedup on levelled sorted runs of line hashes, with DataFrame operations only.

A run is a table of (h1, h2, doc_id): the hash of each line key and the smallest document that holds it, bucketed and
sorted by hash with one file a bucket, so that a merge join reads it in place, without a shuffle or a sort. Its files are
below the cluster's checkpoint folder; buckets are as many as the lines of all batches need at BUCKET_ROWS each. Batches
of documents come in ascending ranges of doc_id. Each batch anti-joins its own smallest holders to all runs, adds what is
left as a run of level 0, and marks every line whose (key, document) isn't among those holders. When a level has FANOUT
runs and another batch follows, they are merged into one of the next. Runs are dropped at the end, failed or not.

Cases: a null or empty text is one empty line; keys under MIN_POINTS code points always stay; several rows of one
doc_id are one document for the purpose of dropping (a line of theirs is a repeat only if a smaller doc_id holds it);
rows without doc_id are returned unchanged and hold nothing back; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources.store import remove, saved, scratch

MIN_POINTS = 10
BATCHES = 4
FANOUT = 2
BUCKET_ROWS = 20_000_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_key(line):
    """The line without ASCII white space at its ends, its ASCII letters in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


#: The session option by which scans of one sorted file a bucket report their order.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
#: A union that reports its inputs' buckets makes Spark drop the repartition of a merge, which then has several files a bucket.
_OPTIONS = {_ORDERED: "true", "spark.sql.unionOutputPartitioning": "false"}


class LineRuns:
    """The levels of runs; add() takes the next batch of hashed lines and returns those to drop.

    rows are the lines of all batches together, at most. A context: on leaving it, the runs and what it set in the
    session are gone.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, rows: int = 0, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.fanout, self.levels, self.folders = spark, fanout, [], {}
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # Spark takes no more; buckets then grow
        self.buckets = min(most, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / bucket_rows)))

    def __enter__(self) -> LineRuns:
        self.before = {name: self.spark.conf.get(name, None) for name in _OPTIONS}
        for name, value in _OPTIONS.items():
            self.spark.conf.set(name, value)
        return self

    def __exit__(self, *_) -> None:
        for name, value in self.before.items():
            if value is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, value)
        for level in self.levels:
            self._drop(level)
        self.levels = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.folders[name] = scratch(self.spark, name)
        try:
            keys.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.folders[name]).saveAsTable(name)
        except Exception:
            self._drop([name])
            raise
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.folders.pop(name))

    def compact(self, level: int = 0) -> None:
        """Merges the runs of a full level, whose keys are disjoint, into one of the next level, and so on."""
        if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
            return
        runs = self.levels[level]
        merged = self.spark.table(runs[0])
        for name in runs[1:]:
            merged = merged.unionByName(self.spark.table(name))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged))
        self.levels[level] = []
        self._drop(runs)
        self.compact(level + 1)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def holders(self, lines: DataFrame) -> DataFrame:
        """(h1, h2, doc_id) of keys that no run holds, with the smallest document of lines that holds each."""
        own = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
        for run in self.runs():
            own = own.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return own

    def add(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (h1, h2, doc_id, ...) whose key an earlier batch or a smaller doc_id of this one holds."""
        own = self.holders(lines)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(own))
        held = self.spark.table(self.levels[0][-1])
        dropped = lines.join(held, ["h1", "h2", "doc_id"], "left_anti")
        return dropped


def hashed_lines(documents: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, t, pos, h1, h2) of every line whose key is long enough; t tells texts of one doc_id apart, h1 and h2 make a 128-bit hash."""
    lines = documents.where("doc_id is not null").select("doc_id", text_hash(F.col("text")).alias("t"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_points)
    return keyed.select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("folium"), "key").alias("h2"))


def bounds(documents: DataFrame, batches: int) -> list[int]:
    """Ascending values of doc_id that split the documents into batches of about the same size."""
    cuts = documents.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def repeated_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, t, pos) of every line to drop; t is text_hash() of its text."""
    spark = documents.sparkSession
    cuts = bounds(documents, batches) if batches > 1 else []
    batch = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = scratch(spark, "lines")
    hashed_lines(documents, min_points).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("doc_id long, t long, pos int, h1 long, h2 long, batch int").parquet(path)
    out = []
    with LineRuns(spark, fanout, hashed.count()) as runs:
        for b in range(len(cuts) + 1):
            runs.compact()
            out.append(saved(runs.add(hashed.where(F.col("batch") == b).drop("batch")).select("doc_id", "t", "pos"), "dropped-lines"))
    remove(spark, path)
    dropped = out[0]
    for more in out[1:]:
        dropped = dropped.unionByName(more)
    return dropped


def dedup_lines(documents: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_points: int = MIN_POINTS) -> DataFrame:
    """documents with repeated lines taken out of text, and the columns n_lines and n_dropped; every row stays.

    Positions to drop become a bit set of longs for each document, so a line's bit is found at once however many
    lines its document has. The only shuffle of texts is the last join, by doc_id.
    """
    dropped = repeated_lines(documents, batches, fanout, min_points)
    words = dropped.distinct().groupBy("doc_id", "t", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"), F.count("*").alias("n"))
    sets = words.groupBy(F.col("doc_id").alias("_drop_id"), F.col("t").alias("_drop_t")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("_words"), F.sum("n").alias("_n"))
    dense = F.when(F.size("_words") == F.element_at("_words", -1)["word"] + 1, F.transform("_words", lambda w: w["bits"])).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("_words", -1)["word"]), lambda i: F.coalesce(F.try_element_at(F.map_from_entries("_words"), i), F.lit(0).cast("long")))
    )
    sets = sets.select("_drop_id", "_drop_t", "_n", dense.alias("_bits"))
    own, n, bits = split_lines(documents["text"]), sets["_n"], sets["_bits"]  # by frame, so that no name can clash
    kept = F.filter(own, lambda line, i: F.coalesce(F.getbit(F.get(bits, (i / 64).cast("int")), i % 64), F.lit(0).cast("byte")) == 0)
    text = F.when(n.isNull(), F.coalesce(documents["text"], F.lit(""))).otherwise(F.array_join(kept, "\n"))
    made = {"text": text, "n_lines": F.size(own).cast("long"), "n_dropped": F.coalesce(n, F.lit(0)).cast("long")}
    joined = documents.join(sets, (documents["doc_id"] == sets["_drop_id"]) & (text_hash(documents["text"]) == sets["_drop_t"]), "left")
    return joined.select(*(made[c].alias(c) if c in made else documents[c] for c in [*documents.columns, *(c for c in made if c not in documents.columns)]))
