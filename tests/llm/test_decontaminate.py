"""Spaced seeds against laying every item over every place."""

import collections
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import Broadcast

from folium.llm import decontaminate as d


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def overlays(own, item):
    """(start, agreeing words, most of them in LOCAL_SPAN words) wherever the item laid over a document agrees in 8 words or all."""
    where = collections.defaultdict(list)
    for i, w in enumerate(own):
        where[w].append(i)
    agreeing = collections.Counter(i - k for k, w in enumerate(item) for i in where.get(w, ()))
    for start, n in agreeing.items():
        if n >= min(len(item), d.LEAST_WORDS):
            same = [0 <= start + k < len(own) and own[start + k] == w for k, w in enumerate(item)]
            yield start, n, max(sum(same[i : i + d.LOCAL_SPAN]) for i in range(len(item)))


def brute(documents, items, share=d.SHARE):
    out = set()
    for doc_id, text in documents:
        own, lines, at = words(text), set(), 0
        for line in (text or "").split("\n"):
            lines.add((at, at := at + len(words(line))))
        for item_id, item in items:
            item = words(item)
            need = max(int(np.ceil(len(item) * share - 1e-9)), min(len(item), d.LEAST_WORDS))
            if 0 < len(item) < d.LINE_WORDS:
                out |= {(doc_id, item_id, a, len(item), len(item)) for a, b in lines if own[a:b] == item}
                continue
            for start, matched, near in overlays(own, item) if item and {*own} & {*item} else ():
                if matched >= need or near >= d.LOCAL_WORDS:
                    out.add((doc_id, item_id, start, matched, len(item)))
    return out


def found(documents, items, **options):
    return {tuple(r)[:5] for r in d.contaminated(documents, items, **options).collect()}


BLOCKS = pytest.mark.parametrize("block", [500_000, 60])


@BLOCKS
def test_table(spark, sf, block):
    """All documents of the table and all items."""
    documents, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, tests = [(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()]
    want = brute(rows, tests)
    assert found(documents, items, block_words=block) == want and want


@BLOCKS
def test_substitutions_and_odd_rows(spark, block):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"t{i}w{k}" for k in range(n))) for i, n in enumerate([15, 20, 40, 60, 6, 4, 9])] + [(90, None), (91, ""), (None, "a b c d e f g h i j"), (92, "?!")]
    documents = [(1000, None), (1001, ""), (1002, "Clean words only, " * 30), (None, items[0][1]), (1003, items[1][1]), (1003, items[1][1])]
    for n in range(120):
        i = int(rng.integers(0, 7))
        text = items[i][1].split()
        for k in range(len(text)):
            if rng.random() < 0.12:
                text[k] = "changed"
        documents.append((n, " ".join([*["before"] * int(rng.integers(0, 9)), *text[int(rng.integers(0, 3)) :], *["after."] * int(rng.integers(0, 9))])))
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as id").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, want = found(df, bench, block_words=block), brute([x for x in documents if x[0] is not None], [x for x in items if x[0] is not None])
    assert got == want
    assert not {1000, 1001, 1002} & {g[0] for g in got}
    left = d.decontaminate(df, bench, block_words=block)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {x[0] for x in documents} - {g[0] for g in got}


@BLOCKS
def test_several_texts_of_one_id(spark, block):
    whole = [f"w{k}" for k in range(20)]
    changed = [w if k % 2 else "x" for k, w in enumerate(whole)]
    documents = [(1, " ".join(whole)), (1, " ".join(changed)), (2, "other " * 30), (1, " ".join(whole))]
    items = [(7, " ".join(whole)), (7, " ".join(reversed(whole))), (7, " ".join(whole))]
    got = found(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert got == brute(documents, items) >= {(1, 7, 0, 20, 20), (1, 7, 0, 10, 20)}


def test_short_items_are_whole_lines(spark):
    documents = [(1, "Two and two\nis four"), (2, "they say two and two is four"), (3, "x\nTWO, and two!"), (4, "two and"), (5, "two and two"), (6, "four\n\n")]
    items = [(1, "two and two"), (2, "four"), (3, "is four")]
    got = found(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == {(1, 1, 0, 3, 3), (1, 3, 3, 2, 2), (3, 1, 1, 3, 3), (5, 1, 0, 3, 3), (6, 2, 0, 1, 1)} == brute(documents, items)


def test_one_window_of_many(spark, monkeypatch):
    """A passage that many items and documents share is looked at in parts."""
    monkeypatch.setattr(d, "HITS", 50)
    items = d._Items(list(range(40)), pa.array([" ".join(f"w{k}" for k in range(12)) + f" own{i}" for i in range(40)]))
    words, first = d._words(pa.array([" ".join(f"w{k}" for k in range(12))] * 9))
    doc, item, start, matched = items.find(words, first, first, 0.5)
    assert sorted(zip(doc.tolist(), item.tolist())) == list(itertools.product(range(9), range(40))) and set(matched.tolist()) == {12}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert found(none, bench) == set()
    assert found(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), bench) == set()


@BLOCKS
def test_parts_of_items(spark, block):
    item = [f"w{k}" for k in range(59)]
    changed = ["x" if k in (22, 25) else w for k, w in enumerate(item)]
    texts = {1: item[30:], 2: item[:20] + item[45:], 3: item[20:29], 4: changed[20:30], 5: item[20:27], 6: item[20:24] + ["x"] * 6 + item[30:37]}
    documents = [(i, " ".join(["before"] * 3 + text + ["after"] * 3)) for i, text in texts.items()]
    got = found(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), block_words=block)
    assert got == {(1, 7, -27, 29, 59), (2, 7, 3, 20, 59), (2, 7, -22, 14, 59), (3, 7, -17, 9, 59), (4, 7, -17, 8, 59)}


@BLOCKS
def test_every_allowed_change_of_short_items(spark, block):
    items, documents = [(n, " ".join(f"t{n}w{k}" for k in range(n))) for n in range(7, 12)], []
    for n, text in items:
        for gone in itertools.combinations(range(n), max(n - d.LEAST_WORDS, 0)):
            documents.append((1000 * n + len(documents), " ".join("x" if k in gone else w for k, w in enumerate(text.split()))))
    got = found(spark.createDataFrame(documents, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
    assert {g[:2] for g in got} == {(i, i // 1000) for i, _ in documents}
    assert got == brute(documents, items)


def changed(rng, n, share):
    """Which of n words stay: exactly the needed ones at a share of 0.5, or each with a chance."""
    if share == 0.5:
        return np.isin(np.arange(n), rng.permutation(n)[: int(d._needed(np.array([n]), 0.5)[0])])
    return rng.random(n) >= share


def test_every_overlay_is_found(spark):
    """By length and share of changed words; half of them at random places, and every second word; some texts cut off."""
    rng, items, documents = np.random.default_rng(5), [], []
    for n in [8, 9, 10, *range(12, 41), 60]:
        item = [f"t{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        stays = [changed(rng, n, share) for share in (0.2, 0.3, 0.4) for _ in range(10)] + [changed(rng, n, 0.5) for _ in range(60)] + [np.arange(n) % 2 == odd for odd in (0, 1)]
        for stay in stays:
            text = [w if s else f"x{k}" for k, (w, s) in enumerate(zip(item, stay))]
            documents.append((len(documents), " ".join(text[int(rng.integers(0, 2)) :])))
    got = found(spark.createDataFrame(documents, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(documents, items)
    assert {got_n for got_n in (g[4] for g in got)} == {n for n, _ in items}


@pytest.mark.parametrize("share", [0.25, 0.4, 0.8])
def test_other_shares(share):
    rng, items, documents = np.random.default_rng(6), [], []
    for n in (10, 24, 33, 50):
        items.append((n, " ".join(f"t{n}w{k}" for k in range(n))))
        for _ in range(40):
            stay = rng.permutation(n)[: int(d._needed(np.array([n]), share)[0])]
            documents.append((len(documents), " ".join(w if k in stay else "x" for k, w in enumerate(items[-1][1].split()))))
    own = d._Items([i for i, _ in items], pa.array([t for _, t in items]), share)
    words, first = d._words(pa.array([t for _, t in documents]))
    doc, item, start, matched = own.find(words, first, first, share)
    assert set(zip(doc.tolist(), own.ids[item].tolist(), start.tolist(), matched.tolist(), own.size[item].tolist())) == brute(documents, items, share)


def test_few_overlays_are_laid():
    """Frequent words in common make hits, but seldom enough on one overlay."""
    rng = np.random.default_rng(7)
    frequent = [f"w{k}" for k in np.minimum(rng.zipf(1.3, 60_000), 5_000)]
    items = d._Items(list(range(50)), pa.array([" ".join(frequent[k * 30 : k * 30 + 30]) for k in range(50)]))
    words, first = d._words(pa.array([" ".join(frequent[k : k + 500]) for k in range(2_000, 60_000, 500)]))
    hits = sum(int(n.sum()) for *_, n, _ in items._hits(words, first))
    laid = sum(len(doc) for doc, _, _ in items._overlays(words, first, first))
    assert 0 < laid < hits / 4


def test_one_very_long_text(spark, monkeypatch):
    """An item at the end of a text of 400,000 words, whose hits go beyond what is looked at together."""
    monkeypatch.setattr(d, "HITS", 1_000)
    item = [f"w{k}" for k in range(30)]
    text = (item[:5] + ["x"] * 3) * 2_000 + [f"y{k}" for k in range(400_000)] + [w if k % 2 else "z" for k, w in enumerate(item)]
    own = d._Items([3], pa.array([" ".join(item)]))
    words, first = d._words(pa.array([None, " ".join(text), ""]))
    doc, _, start, matched = own.find(words, first, first, 0.5)
    assert (doc.tolist(), start.tolist(), matched.tolist()) == ([1], [416_000], [15])


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """Each block's broadcast is gone before the next one is made."""
    held, make, destroy = [], d._Items.__init__, Broadcast.destroy
    monkeypatch.setattr(d._Items, "__init__", lambda *a: held.append(1) or make(*a))
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: held.append(-1) or destroy(self, *a))
    items = [(i, " ".join(f"t{i}w{k}" for k in range(20))) for i in range(12)]
    documents = spark.createDataFrame(items, "doc_id long, text string")
    got = d.contaminated(documents, spark.createDataFrame(items, "item_id long, text string"), block_words=100)
    assert len(held) > 4 and np.cumsum(held).max() == 1 and sum(held) == 0
    assert {tuple(r)[:4] for r in got.collect()} == {(i, i, 0, 20) for i in range(12)}
