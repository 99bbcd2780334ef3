"""The pipeline's stages against brute force, each on its own input, and the whole of run()."""

import re

import pytest

import corpus_pipeline as cp
from folium.llm import quality
from tests.llm import test_decontaminate, test_neardup, test_packing


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def deduped(rows):
    """Lines whose key a smaller doc_id holds are dropped; documents left without text by that go."""
    first = {}
    for doc_id, text in sorted(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if first.get(key(line), doc_id) == doc_id]
        if len(kept) == len(lines) or "\n".join(kept).strip(" \t\n\x0b\x0c\r"):
            out.append((doc_id, "\n".join(kept)))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_quality(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    trees = quality.learn(documents, labels)
    want = [(r["doc_id"], r["text"]) for r in documents.collect() if trees.score(quality.statistics(__import__("pyarrow").array([r["text"]])))[0] >= quality.THRESHOLD]
    out = cp.good_quality(spark, documents, sf)
    assert out.columns == documents.columns and pairs(out) == sorted(want)
    right = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {d for d, _ in want}
    assert sum((d in kept) == bool(q) for d, q in right.items()) >= 0.97 * len(right)


def test_lines(spark, sf, documents):
    rows = pairs(documents)
    out = cp.distinct_lines(spark, documents, sf)
    assert out.columns == documents.columns and pairs(out) == sorted(deduped(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_run(spark, sf, documents):
    docs = cp.good_quality(spark, documents, sf)
    rows = deduped(pairs(docs))
    classes = test_neardup.brute(rows)
    rows = [r for r in rows if classes[r[0]] == r[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 2]) for _, t in items for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 1)}
    hit = set()
    for doc_id, text in rows:  # only documents that share a pair of words can hold an item
        w = re.findall(r"\w+", text.lower())
        if sum((a, b) in grams for a, b in zip(w, w[1:])) >= 8:
            hit |= {x[0] for x in test_decontaminate.brute([(doc_id, text)], items)}
    texts = {d: t for d, t in rows if d not in hit}
    out = cp.run(spark, sf).collect()
    assert test_packing.whole(out, texts) == 0
    assert len(cp.STAGES) == 5


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "A clean line of words.\nAnother line here.", "en", "s", 40), (3, "A clean line of words.\nAnother line here.", "en", "s", 40), (None, "x", "en", "s", 1)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() >= 3
    docs.where("false").write.parquet(f"{tmp_path}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/e").count() == 0
