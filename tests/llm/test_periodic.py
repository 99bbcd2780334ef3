"""Periodic runs against a search over all periods, and the registered query against hand-worked rows."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folium.llm.periodic import collapse, collapsed


def brute(w, least=6, periods=4):
    """(start, length, period) of every run, by walking the words once for each period."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def check(texts, least=6, periods=4):
    counts, runs, kept = collapsed(pa.array(texts, pa.string()), least, periods)
    for text, n, own, out in zip(texts, counts, runs, kept, strict=True):
        w = (text or "").encode().split()
        want = brute(w, least, periods)
        assert [(r["start"], r["length"], r["period"]) for r in own] == want and n == len(w)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert out == b" ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 40)), max_size=5))
def test_repeated_blocks(blocks):
    check([" ".join("".join((word * n)[: n * 2] for word, n in blocks))])


def test_many_documents_of_a_batch():
    rng = random.Random(4)
    texts = []
    for _ in range(800):
        text = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choices("abcd", k=rng.randint(1, 12))
            text += (p * 9)[: rng.randint(1, 9 * len(p))]
        texts.append(rng.choice([" ", "\n", " \t\x0b\x0c\r"]).join(text))
    check([*texts, None, "", " \n", "a", "a a " * 9, "　x " * 7])
    check(texts, 10, 5)


def test_fewer_than_four_periods_are_refused(spark):
    with pytest.raises(ValueError):
        collapse(spark.createDataFrame([("a",)], "text string"), periods=3)


def test_nested_and_overlapping_runs():
    inner = ["a"] * 8 + ["b"]
    check([" ".join(inner * 6), " ".join(["a", "b"] * 5 + ["b"] * 6 + ["a", "b", "c"] * 5), " ".join((["x", "y"] * 4 + ["z"]) * 5)])


def test_very_long_texts():
    n = 300_000
    _, runs, kept = collapsed(pa.array(["ab cd " * n, " ".join(map(str, range(n))), " ".join(str(i % (n // 4)) for i in range(n))]), 6, 4)
    assert [[tuple(r.values()) for r in own] for own in runs] == [[(0, 2 * n, 2)], [], [(0, n, n // 4)]]
    assert kept[0] == b"ab cd" and len(kept[2].split()) == n // 4


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a " * 9, 6), (2, "", 7), (2, "", 7), (3, "x y " * 4, 8), (3, "q", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long").withColumn("n.b", F.lit(1))
    out = collapse(df)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["n.b"])) for r in out.collect())
    assert got == [(False, 1, "", 0, [], 1), (False, 2, "", 0, [], 1), (False, 2, "", 0, [], 1), (False, 3, "q", 1, [], 1), (False, 3, "x y", 8, [(0, 8, 2)], 1), (True, 0, "a", 9, [(0, 9, 1)], 1)]
    assert collapse(df.limit(0)).collect() == []


def test_query_equals_sql(spark, sf):
    import duckdb

    from folium.llm import queries

    con = duckdb.connect()
    for name, tables in (("op11_periodic_runs", ["documents"]), ("op13_vector_codes", ["embeddings"])):
        for t in tables:
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        got = queries.queries()[name](spark, sf)
        want = con.sql(queries.oracle_sql()[name]).select(*got.columns)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
        assert name != "op11_periodic_runs" or got.where("n_runs > 0 and period > 5").count() > 3
