"""Vector search through the index against whole products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.operators import ranking
from folium.operators.vector_index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>, status string"


def clustered(n, width, seed, start=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(30, width))
    x = (middles[rng.integers(30, size=n)] + 0.15 * rng.normal(size=(n, width))).astype(np.float32)
    return [(start + i, v.tolist(), "active" if i % 5 else "inactive") for i, v in enumerate(x)]


def brute(queries, rows, n):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for qid, q in queries:
        scores = np.round(x @ np.array(np.float32(q), np.float64), 10)
        order = np.lexsort((ids, -scores))[:n]
        out[qid] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["n"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(4000, 12, 1) + [(9000 + i, clustered(1, 12, 1)[0][1], "active") for i in range(1500)]  # a hot cell of copies
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA).repartition(6), str(tmp_path_factory.mktemp("index") / "ix"), cells=40)
    return rows, index


def test_exact_and_probed(spark, built):
    rows, index = built
    queries = [(i, rows[37 * i][1]) for i in range(60)] + [(100, [0.0] * 12), (101, [50.0] + [0.0] * 11)]
    df = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    want = brute(queries, rows, 30)
    assert found(index.nearest(df, 30)) == want
    probed = found(index.nearest(df.where("query_id < 100"), 30, probes=6, exact=False))
    recall = np.mean([len({v for v, _ in probed[q]} & {v for v, _ in want[q]}) / 30 for q in probed])
    assert len(probed) == 60 and recall >= 0.9


def test_reads_few_cells(spark, built, monkeypatch):
    """The exact search stops: clustered queries meet a small share of all chunks."""
    rows, index = built
    met = []
    real = VectorIndex._products
    monkeypatch.setattr(VectorIndex, "_products", lambda self, pairs, n: met.append(pairs.count()) or real(self, pairs, n))
    df = spark.createDataFrame([(i, rows[37 * i][1]) for i in range(60)], "query_id long, embedding array<float>")
    index.nearest(df, 10, probes=3).collect()
    assert met[0] == 180 and sum(met) < 60 * 40 * 0.6


def test_added_vectors_are_found_without_a_new_fit(spark, built, tmp_path):
    rows, more = clustered(1500, 8, 3), [*clustered(500, 8, 4, start=5000), (7000, [30.0] * 8, "active")]
    index = VectorIndex.build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/ix")
    before = index.centres()
    index.add(spark.createDataFrame(more, SCHEMA))
    queries = [(r[0], r[1]) for r in (rows + more)[::90]]
    df = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    assert (index.centres() == before).all() and found(index.nearest(df, 20)) == brute(queries, rows + more, 20)
    again = VectorIndex(spark, f"{tmp_path}/ix")  # from the path alone
    assert found(again.nearest(df, 20)) == found(index.nearest(df, 20))


def test_odd_vectors_and_states(spark, tmp_path):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "active"), (2, [0.9, 0.0], "inactive"), (3, [0.8, 0.0], "active"), (4, None, "active"), (5, [nan, 1.0], "active"), (6, [1.0, None], "active"), (7, [1.0], "active"), (8, [], "active"), (9, [0.8, 0.0], "active")]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [1.0]), (5, [1.0, None])], "query_id long, embedding array<float>")
    hits = ranking.vector_search(queries, df, 2, over=2)
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in hits.orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 3, 2)]
    assert {r["query_id"]: r["missing"] for r in ranking.shortfalls(queries, hits, 2).collect()} == {2: 2, 3: 2, 4: 2, 5: 2}
    empty = ranking.vector_search(queries, df.where("vec_id = 4"), 2)
    assert empty.count() == 0 and ranking.vector_search(queries.limit(0), df, 2).count() == 0


def test_states_are_those_of_now(spark, tmp_path):
    rows = clustered(300, 6, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(df, f"{tmp_path}/ix")
    queries = spark.createDataFrame([(0, rows[0][1])], "query_id long, embedding array<float>")
    first = ranking.vector_search(queries, df, 3, index=index).first()["vec_id"]
    later = df.withColumn("status", F.when(F.col("vec_id") == first, "inactive").otherwise(F.col("status")))
    assert first not in {r["vec_id"] for r in ranking.vector_search(queries, later, 3, index=index).collect()}
