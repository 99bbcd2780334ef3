"""A corpus from raw documents to packed sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; what a stage decides takes effect in its rows. n_chars follows the text where lines are dropped.
run() keeps the last stage's table only. Rows without doc_id pass every stage, since nothing can be said of them by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.decontaminate import decontaminate
from folium.llm.lines import dedup_lines
from folium.llm.neardup import dedup
from folium.llm.packing import pack
from folium.llm.quality import learn, scored
from folium.sources.store import Steps


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scores = scored(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rejected = scores.where("predicted = 0").select(F.col("doc_id").alias("_rejected")).distinct()
    return docs.join(rejected, docs["doc_id"] == rejected["_rejected"], "left_anti")


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id holds; one whose text is all gone goes."""
    kept = dedup_lines(docs)
    gone = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    return kept.where(~gone).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return dedup(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    return pack(docs)


STAGES = [("quality", good_quality), ("line dedup", distinct_lines), ("near-dedup", one_of_each_group), ("decontamination", no_benchmark), ("packing", packed)]

#: Trees, weighted samples and token ids are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Steps(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = kept.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
