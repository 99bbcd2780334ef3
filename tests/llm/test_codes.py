"""Codes against brute force: nearest entries, refitted codebooks, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm.codes import Slices, codes, kept, learn, with_group_error

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("entries", "width", "spread"), [(256, 16, 130), (256, 3, 2), (65, 5, 40), (1, 4, 10), (200, 1, 5), (256, 8, 1 << 25)])
def test_nearest(entries, width, spread):
    rng = np.random.default_rng(entries + width)
    e = rng.integers(-spread, spread + 1, (entries, width))
    x = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (3000, width)), e])
    index, distance = Slices(e).nearest(x)
    whole = np.stack([((x - one) ** 2).sum(1) for one in e], 1)
    assert (index == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error) and the codebooks by whole distance tables in Python integers."""
    rows = sorted(rows, key=lambda r: r[0])
    ints = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for v in ints] for p in range(parts)]
    books, out = [c[:entries] for c in cut], None
    for step in range(rounds + 1):
        out = [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p])) for x in cut[p]] for p in range(parts)]
        if step < rounds:
            for p in range(parts):
                for i in range(len(books[p])):
                    own = [x for x, (_, j) in zip(cut[p], out[p], strict=True) if j == i]
                    if own:
                        books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return {r[0]: ([out[p][i][1] for p in range(parts)], sum(out[p][i][0] for p in range(parts))) for i, r in enumerate(rows)}, books


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.1], int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(150)]  # copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    books = learn(df)
    want, codebooks = brute(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in codes(df, books).collect()} == want
    assert [b.tolist() for b in books.books] == codebooks


def test_few_vectors_and_odd_lengths(spark):
    rows = [(i, [0.1 * i, -0.2, 0.3, 0.4 * i, 0.5, 0.6, 0.7], 0) for i in range(5)]
    books = learn(spark.createDataFrame(rows, SCHEMA))
    assert [b.shape for b in books.books] == [(5, 1), (5, 2), (5, 2), (5, 2)]
    assert all(r["error"] == 0 for r in codes(spark.createDataFrame(rows, SCHEMA), books).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, 0.2, -0.3, 0.4], 1 if i else None) for i in range(4)]
    bad = [(10, None, 1), (11, [0.1, None, 0.2, 0.3], 1), (12, [0.1, nan, 0.2, 0.3], 1), (13, [0.1, inf, 0.2, 0.3], 1), (14, [0.1, -inf, 0.2, 0.3], 1)]
    odd = [(20, [0.5], None), (21, [], 2), (2, [0.2, 0.2, -0.3, 0.4], 1), (None, [0.3, 0.2, -0.3, 3e38], None)]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).withColumns({"error": F.lit("x"), "code": F.lit(1), "a.b": F.lit(2), "group_error": F.lit("y")})
    out = codes(df.drop("group_error"), learn(df)).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in out if r["vec_id"] is not None) == [(False, i) for i in (0, 1, 2, 2, 3, 20, 21)] and len(out) == 8
    assert all((r["code"] is None) == (r["vec_id"] in (20, 21)) and (r["error"] is None) == (r["vec_id"] in (20, 21)) for r in out)
    assert {r["a.b"] for r in out} == {2}


def test_group_error(spark):
    rows = [(i, [float(i), 0.0, 1.0, 2.0], None if i < 100 else 7 if i < 3000 else i) for i in range(4500)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = with_group_error(codes(df, learn(df, entries=4, rounds=1)))
    got = out.collect()
    total = {}
    for r in got:
        total[r["label"]] = total.get(r["label"], 0) + r["error"]
    assert len(got) == 4500 and all(r["group_error"] == total[r["label"]] for r in got)


def test_empty(spark):
    for rows in ([], [(1, None, 2)]):
        df = spark.createDataFrame(rows, SCHEMA)
        books = learn(df)
        assert with_group_error(codes(df, books)).collect() == [] and books.listed() == "" and kept(df).count() == 0
