"""Trees: the walk over arrays against one by hand, learning, held-out labels, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from folium.llm import quality as q


def walk(trees, row):
    total = trees.base
    for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > bound[at])
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_walk_and_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = q.fit(x[:400], y[:400], trees=30, depth=3)
    scores = trees.score(x)
    assert np.allclose(scores[:50], [walk(trees, row) for row in x[:50]])
    assert ((scores[400:] > 0.5) == y[400:]).mean() > 0.9


def test_table(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in q.quality(documents, labels).collect()}
    assert len(got) == documents.count()
    right = []
    for r in labels.collect():
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if got[r["doc_id"]]["held_out"]:
            right.append(got[r["doc_id"]]["predicted"] == r["quality"])
    assert np.mean(right) > 0.95 and len(right) > 50


def test_held_out_labels_are_not_learnt(spark, sf):
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    wrong = labels.withColumn("quality", __import__("pyspark").sql.functions.when(q.held_out(), 1 - labels["quality"]).otherwise(labels["quality"]))
    score = lambda x: {r["doc_id"]: r["score"] for r in q.quality(documents, x).collect()}
    assert score(labels) == score(wrong)


def test_statistics_of_one_and_many():
    texts = ["A b.\nc!! 12", None, "", "   ", "é" * 5000, "x\n" * 40, "word " * 3000]
    together = q.statistics(pa.array(texts))
    assert together.shape == (7, len(q.STATISTICS)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(q.statistics(pa.array([t]))[0], together[i])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1), (1, 5)], "doc_id long, quality int")
    rows = q.quality(docs, labels).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.5, 1)] * 3
    assert q.quality(docs.where("false"), labels).count() == 0
