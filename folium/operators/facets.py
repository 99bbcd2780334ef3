"""Keyword facets of library searches by bitmaps (A1).

Items are numbered in the order in which they lend their spelling to a term: the one updated last first. Buckets of 2**15
numbers hold a bitmap for each status, year, venue and keyword. Each distinct filter is settled once: its bitmaps are and-ed
bucket by bucket, and blocks of filters meet blocks of keywords of the same bucket. Requests meet their filter's counts
at the end, so nothing has a row for each request and item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import casefold
from folium.sources.store import saved

FACETS = 80
BUCKET = 1 << 15
BLOCK = 128  # bitmaps of 4 KB in one row
_FILTER = ("status", "year_from", "year_to", "venue")


def _bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, bucket, bits) of rows (*keys, number)."""
    return rows.groupBy(*keys, F.expr(f"number div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("number") % BUCKET).alias("bits"))


def _heads(text: Column) -> Column:
    """Runs of up to three letters of which a text holding another must hold the other's first three."""
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n))
    return F.array_distinct(F.concat(run(3), run(2), run(1), F.array(F.lit(""))))


def _filter_bits(items: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, bucket, bits): the items that each filter (filter, status, year_from, year_to, venue) lets pass."""
    every = _bitmaps(items.select("number"))
    statuses, years = _bitmaps(items.where("reading_status is not null"), "reading_status"), _bitmaps(items.where("year is not null"), "year")
    venues = saved(_bitmaps(items.where("venue is not null").withColumn("venue", F.lower("venue")), "venue"), "venue-bits")
    by_status = filters.where("status is not null").join(statuses, F.col("status") == F.col("reading_status")).select("filter", F.lit("status").alias("kind"), "bucket", "bits")
    known = [r[0] for r in items.where("year is not null").select("year").distinct().collect()]  # a number for each year
    low, high = F.coalesce("year_from", F.lit(-(2**31))), F.coalesce("year_to", F.lit(2**31 - 1))
    dated = filters.where("year_from is not null or year_to is not null").select("filter", F.explode(F.filter(F.array(*map(F.lit, known)).cast("array<int>"), lambda y: (y >= low) & (y <= high))).alias("year"))
    by_year = dated.join(years, "year").select("filter", F.lit("year").alias("kind"), "bucket", "bits")
    asked = filters.where("venue is not null").select("filter", F.lower(F.trim("venue")).alias("part"))
    names = venues.select("venue").distinct().select("venue", F.explode(_heads(F.col("venue"))).alias("head"))
    held = asked.withColumn("head", F.substring("part", 1, 3)).join(names, "head").where(F.contains("venue", "part")).select("filter", "venue")
    by_venue = held.join(venues, "venue").select("filter", F.lit("venue").alias("kind"), "bucket", "bits")
    kinds = by_status.unionByName(by_year).unionByName(by_venue).groupBy("filter", "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    asks = lambda *c: F.when(F.coalesce(*c).isNotNull(), 1).otherwise(0)
    needs = filters.select("filter", (asks(F.col("status")) + asks(F.col("year_from"), F.col("year_to")) + asks(F.col("venue"))).alias("needs"))
    met = kinds.groupBy("filter", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).join(needs, "filter").where("n = needs").select("filter", "bucket", "bits")
    # A filter that asks for nothing passes all items; it is one at most.
    return met.unionByName(every.withColumn("_", F.lit(0)).join(needs.where("needs = 0").select("filter", F.lit(0).alias("_")), "_").select("filter", "bucket", "bits"))


def _blocks(bits: DataFrame, key: str) -> DataFrame:
    """(bucket, names, bits): about BLOCK bitmaps of a bucket in each row."""
    size = bits.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("m"))
    return bits.join(size, "bucket").groupBy("bucket", F.pmod(F.xxhash64(key), F.col("m")).alias("_block")).agg(F.collect_list(F.struct(F.col(key).alias("name"), "bits")).alias(f"{key}s")).drop("_block")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(filter, key, n, first) of each filter and keyword of a bucket that share items: how many, and the least number."""
    for batch in batches:
        for bucket, filters, keys in zip(batch["bucket"].to_pylist(), batch["filters"], batch["keys"], strict=True):
            one, two = (np.frombuffer(b"".join(x.values.field("bits").to_pylist()), np.uint8).reshape(len(x.values), -1) for x in (filters, keys))
            names = keys.values.field("name")
            for name, bits in zip(filters.values.field("name").to_pylist(), one, strict=True):
                both = two & bits
                n = np.bitwise_count(both).sum(1, dtype=np.int64)
                some = np.flatnonzero(n)
                byte = (both[some] != 0).argmax(1)
                lowest = both[some, byte]
                first = bucket * BUCKET + 8 * byte.astype(np.int64) + np.log2((lowest & -lowest.astype(np.int16)).astype(np.float64)).astype(np.int64)
                yield pa.record_batch([pa.array([name] * len(some), pa.string()), names.take(pa.array(some)), pa.array(n[some]), pa.array(first)], ["filter", "key", "n", "first"])


def facets(library: DataFrame, requests: DataFrame, n: int = FACETS) -> DataFrame:
    """A1: (request_id, keyword, count, rank): terms of the items that a request finds when its keyword is left out.

    A term counts once for an item; it is shown as the item updated last, with the smallest key, spells it last. library is
    (item_key, updated_at, reading_status, year, venue, tags, keywords), requests (request_id, status, year_from, year_to,
    venue); null means any.
    """
    terms = F.transform(F.filter(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("keywords", F.array().cast("array<string>"))), lambda t: F.trim(t) != ""), lambda t: F.trim(t))
    ordered = library.select("item_key", "updated_at", "reading_status", "year", "venue", terms.alias("terms")).orderBy(F.desc_nulls_last("updated_at"), F.asc("item_key"))
    items = saved(ordered.withColumn("number", F.monotonically_increasing_id()), "items")
    each = items.select("number", F.posexplode("terms").alias("pos", "term")).withColumn("key", casefold("term"))
    spelt = saved(each.groupBy("number", "key").agg(F.max_by("term", "pos").alias("shown")), "item-terms")
    asked = requests.select("request_id", *_FILTER).withColumn("filter", F.to_json(F.struct(*_FILTER), {"ignoreNullFields": "false"}))
    filters = saved(_filter_bits(items, asked.select("filter", *_FILTER).distinct()), "filter-bits")
    pairs = _blocks(filters, "filter").join(_blocks(_bitmaps(spelt, "key"), "key"), "bucket").select("bucket", "filters", "keys")
    counts = pairs.mapInArrow(_counts, "filter string, key string, n long, first long").groupBy("filter", "key").agg(F.sum("n").alias("count"), F.min("first").alias("number"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("filter").orderBy(F.desc("count"), "key"))).where(F.col("rank") <= n)
    shown = best.join(spelt, ["number", "key"]).select("filter", F.col("shown").alias("keyword"), "count", "rank")
    return asked.select("request_id", "filter").join(shown, "filter").select("request_id", "keyword", "count", "rank")
