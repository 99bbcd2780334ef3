"""Summaries of log segments against a plain fold of the whole log."""

import random

import pytest
from pyspark.sql import functions as F

from folium.operators import library

SCHEMA = "item_key int, seq long, ts long, action string, paper_id string, note string, reading_status string, tags array<string>, has_note boolean, has_status boolean, has_tags boolean"


def rows_of(seed, n=900, items=12):
    r, rows = random.Random(seed), []
    for seq in range(n):
        item = 0 if r.random() < 1 / 3 else r.randrange(1, items)
        action = r.choices(["save", "update", "delete"], [4, 5, 1 if item else 0.1])[0]
        tags = None if r.random() < 0.1 else [r.choice(["AI", "ai", "Ml", "ml", "x", "Straße", "STRASSE", "z"]) for _ in range(r.randrange(4))]
        rows.append((item, seq, r.randrange(10_000), action, f"p{seq}", r.choice([None, f"n{seq}"]), r.choice([None, "unread", "reading", "read"]), tags, r.random() < 0.4, r.random() < 0.4, r.random() < 0.2))
    return rows


def plain(rows):
    items = {}
    for item, _, ts, action, paper, note, status, tags, has_note, has_status, has_tags in sorted(rows, key=lambda x: x[1]):
        if action == "delete":
            items.pop(item, None)
            continue
        if action == "update" and item not in items:
            continue
        s = items.setdefault(item, {"paper": None, "note": None, "status": "unread", "tags": [], "ts": [], "n": 0})
        s["ts"].append(ts)
        if action == "save":
            s["paper"], s["n"] = paper, s["n"] + 1
            s["note"] = s["note"] if note is None else note
            s["status"] = s["status"] if status in (None, "unread") else status
        else:
            s["note"] = note if has_note else s["note"]
            s["status"] = status if has_status and status is not None else s["status"]
            s["tags"] = [] if has_tags else s["tags"]
        if action == "save" or has_tags:
            for t in tags or ():
                if t.casefold() not in [k.casefold() for k in s["tags"]]:
                    s["tags"].append(t)
    return {k: (s["paper"], s["note"], s["status"], min(s["ts"]), max(s["ts"]), s["n"], s["tags"]) for k, s in items.items()}


def got(df):
    return {r["item_key"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_gives_the_fold_of_the_whole_log(spark, seed):
    rows = rows_of(seed)
    log = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    want = plain(rows)
    for width in (1, 7, 50, 400, 100_000):
        assert got(library.folded_items(library.log_parts(log, F.floor(F.col("seq") / width)))) == want, width
    cuts = sorted(random.Random(seed).sample(range(900), 6))
    uneven = sum((F.when(F.col("seq") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    assert got(library.folded_items(library.log_parts(log, uneven))) == want
    assert got(library.fold_log(log)) == {k: (*v[1:5], v[6]) for k, v in want.items()}


def test_parts_merge_in_any_steps_and_can_be_kept(spark, tmp_path):
    rows = rows_of(9)
    log = spark.createDataFrame(rows, SCHEMA)
    for day in range(9):
        library.log_parts(log.where(f"seq div 100 = {day}"), F.lit(day)).write.mode("append").parquet(str(tmp_path / "days"))
    days, want = spark.read.parquet(str(tmp_path / "days")), plain(rows)
    for step in (2, 4, 5):
        assert got(library.folded_items(library.merged_parts(days, F.floor(F.col("segment") / step)))) == want
    first, rest = library.merged_parts(days.where("segment < 5")), library.merged_parts(days.where("segment >= 5")).withColumn("segment", F.lit(1).cast("long"))
    assert got(library.folded_items(first.unionByName(rest))) == want


def test_saves_alone_are_the_same_fold(spark):
    rows = [r for r in rows_of(4) if r[3] == "save"]
    log = spark.createDataFrame(rows, SCHEMA)
    saves = library.fold_saves(log).select("item_key", "paper_id", "note", "reading_status", "saved_at", "updated_at", "n_saves", "tags")
    assert got(library.folded_items(library.log_parts(log, F.floor(F.col("seq") / 60)))) == got(saves) == plain(rows)


def test_odd_logs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(library.fold_log(none)) == {} == got(library.folded_items(library.log_parts(none)))
    rows = [(1, 1, 5, "update", "p", "n", "read", ["a"], True, True, True), (2, 1, None, "save", None, None, None, None, False, False, False), (None, 1, 7, "save", "p", "n", "read", [], False, False, False), (3, 1, 1, "delete", None, None, None, None, False, False, False), (3, 2, 2, "save", "p", "", "odd", ["", ""], None, None, None)]
    log = spark.createDataFrame(rows, SCHEMA).withColumn("segment", F.lit("x")).withColumn("part", F.lit(1))
    want = {2: (None, None, "unread", None, None, 1, []), None: ("p", "n", "read", 7, 7, 1, []), 3: ("p", "", "odd", 2, 2, 1, [""])}
    assert got(library.folded_items(library.log_parts(log.drop("segment"), F.col("seq")))) == want
    assert got(library.folded_items(library.log_parts(log))) == want


def test_a_hot_item_is_many_groups(spark):
    """No group of rows is larger than a segment, and one summary of each is left."""
    log = spark.createDataFrame([(1, i, i, "save" if i % 3 else "update", f"p{i}", None, None, [f"t{i % 7}"], False, False, False) for i in range(20_000)], SCHEMA)
    parts = library.log_parts(log, F.floor(F.col("seq") / 500)).cache()
    assert parts.count() == 40 and parts.selectExpr("max(size(whole.tags))").first()[0] == 7
    assert got(library.folded_items(parts))[1][:1] == ("p19999",)
