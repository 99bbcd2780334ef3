"""Facets against a plain count, their spelling, and the rows that the plan makes."""

import random

import pytest

from folium.operators import facets as fc

SCHEMA = "item_key long, updated_at long, reading_status string, year int, venue string, tags array<string>, keywords array<string>"
ASKED = "request_id long, status string, year_from int, year_to int, venue string"


def passes(item, r):
    _, _, status, year, venue, _, _ = item
    return (r[1] is None or status == r[1]) and (r[2] is None or (year is not None and year >= r[2])) and (r[3] is None or (year is not None and year <= r[3])) and (r[4] is None or (venue is not None and r[4].strip().lower() in venue.lower()))


def brute(items, requests, n):
    out = set()
    for r in requests:
        found = {}
        for item in items:
            if passes(item, r):
                own = {t.strip().lower(): t.strip() for t in [*(item[5] or []), *(item[6] or [])] if t and t.strip()}
                for key, shown in own.items():
                    found.setdefault(key, []).append((-item[1], item[0], shown))
        ranked = sorted(found.items(), key=lambda x: (-len(x[1]), x[0]))[:n]
        out |= {(r[0], min(who)[2], len(who), i + 1) for i, (_, who) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    spell = lambda w: rng.choice([w, w.upper(), w.title(), f" {w} "])
    some = lambda k: rng.choice([None, [], [spell(f"t{rng.randrange(30)}") for _ in range(rng.randrange(k))], ["", None, " "]])
    items = [(i, rng.randrange(50), rng.choice(["read", "reading", None]), rng.choice([None, *range(1990, 2020)]), rng.choice([None, "SRC1", "src12", "Journal of X", ""]), some(4), some(6)) for i in range(900)]
    ask = [(None, None, None, None), ("read", None, None, None), (None, 2000, None, " SRC1 "), ("reading", None, 2010, "of"), (None, 2001, 2001, ""), ("read", 2015, 2000, None), ("none", None, None, None), (None, None, None, "zzz"), (None, 2000, 2018, None)]
    return items, [(j, *ask[j % len(ask)]) for j in range(60)]


def test_equals_a_plain_count(spark, tables):
    items, requests = tables
    got = fc.facets(spark.createDataFrame(items, SCHEMA).repartition(5), spark.createDataFrame(requests, ASKED), 12)
    assert {tuple(r) for r in got.select("request_id", "keyword", "count", "rank").collect()} == brute(items, requests, 12)


def test_filters_are_settled_once(spark, tables, monkeypatch):
    """Whatever the number of requests, as many bitmap rows are made as there are distinct filters and buckets."""
    items, requests = tables
    made = []
    real = fc._filter_bits
    monkeypatch.setattr(fc, "_filter_bits", lambda *a: (lambda df: made.append(df.count()) or df)(real(*a)))
    library = spark.createDataFrame(items, SCHEMA).coalesce(1)
    for many in (requests, [(r[0] + 100 * k, *r[1:]) for k in range(20) for r in requests]):
        fc.facets(library, spark.createDataFrame(many, ASKED), 3).count()
    assert made[0] == made[1] <= 9 * library.rdd.getNumPartitions() * 8


def test_several_buckets(spark):
    items = [(i, 70_000 - i, "read", 2000 + i % 3, "v", ["Even"] if i % 2 == 0 else ["odd"], ["EVEN" if i % 2 == 0 else "x"]) for i in range(70_000)]
    got = fc.facets(spark.createDataFrame(items, SCHEMA).coalesce(1), spark.createDataFrame([(1, "read", None, 2001, None)], ASKED), 5).collect()
    want = sum(i % 2 == 0 for i in range(70_000) if i % 3 < 2)
    odd = sum(i % 2 for i in range(70_000) if i % 3 < 2)
    assert {r["keyword"]: r["count"] for r in got} == {"EVEN": want, "odd": odd, "x": odd}


def test_nothing(spark, tables):
    items, requests = tables
    library, asked = spark.createDataFrame(items, SCHEMA), spark.createDataFrame(requests, ASKED)
    assert fc.facets(library.limit(0), asked).count() == 0 and fc.facets(library, asked.limit(0)).count() == 0
