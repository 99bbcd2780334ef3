"""Token ids in Parquet: list columns with dictionary or delta pages, set row groups and page indexes.

Files hold (part, row, doc_id, n_tokens, tokens) in ascending doc_id order: the documents of part k all come before
those of part k + 1, and `row` numbers them in their part. Documents are dealt out by ranges of doc_id, encoded in place and written by Spark's
Parquet writer, so a reader that wants only n_tokens, or a range of doc_id, skips the pages of tokens by column chunk
and page index. A vocabulary of at most DICTIONARY_IDS ids gets dictionary pages for tokens; otherwise, and for all
other columns, pages are delta-encoded (format version 2).

Cases: a null text is empty and holds the end id alone; rows of one doc_id are ordered by text; rows without doc_id come
first; other columns are ignored; an empty table writes a table without rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.tokens import END, encoded

VOCABULARY = "word_bpe_49k.json"
DICTIONARY_IDS = 65_536
FILE_TEXT_BYTES = 512 << 20  # of text in a file at most, so that the number of files grows with the input
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
SCHEMA = "part int, row long, doc_id long, n_tokens int, tokens array<int>"
SCHEMA_NAMES = ["part", "row", "doc_id", "n_tokens", "tokens"]


def write_tokens(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, files: int | None = None, dictionary: bool = True, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes each document's ids and the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, bounds = encoded(part["text"], vocabulary, end)
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                rows = pa.array(np.arange(done, done + part.num_rows))
                yield pa.record_batch([part["part"], rows, part["doc_id"], pa.array(np.diff(bounds), pa.int32()), tokens], SCHEMA_NAMES)
                done += part.num_rows

    if files is None:
        size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / FILE_TEXT_BYTES))
    ordered = documents.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(encode, SCHEMA)
    options = {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": str(dictionary).lower(),
        "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.block.size.row.check.min": "10", "compression": "zstd",
    }
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files at path, from its stored ids.

    start sums the ids of all documents before: of earlier files by one number for each file, in this one by a window.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch["tokens"]
            bounds, values = tokens.offsets.to_numpy(), memoryview(tokens.values.to_numpy().astype("<u4", copy=False).view(np.uint8))
            sums = [zlib.crc32(values[a:b]) for a, b in itertools.pairwise((4 * bounds).tolist())]
            yield pa.record_batch([batch["part"], batch["doc_id"], batch["row"], pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], ["part", "doc_id", "row", "n_tokens", "ids_crc32"])

    stored = read_tokens(spark, path)
    parts = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row a file
    before, starts = 0, {}
    for part, n in parts:
        starts[part], before = before, before + n
    start = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(max(starts, default=0) + 1))), ",").cast("array<long>")
    rows = stored.select("part", "doc_id", "row", "tokens").mapInArrow(digest, "part int, doc_id long, row long, n_tokens long, ids_crc32 long")
    order = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", (F.get(start, F.col("part")) + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
