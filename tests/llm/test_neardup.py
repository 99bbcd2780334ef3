"""Near-duplicate classes against all pairs on a small fixture."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from folium.llm import neardup
from folium.llm.text import shingled


def brute(rows, similarity=0.8):
    """Classes by comparing all pairs: words by a pattern, shingles as tuples, weights from hashed frequencies."""
    idf_of = {}
    shingles, bag = [], []
    for _, text in rows:
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        bag.append({s: runs.count(s) for s in set(runs)})
    for b in bag:
        for s in b:
            if s not in idf_of:
                _, _, _, ids, _ = next(shingled(pa.array([" ".join(s)])))
                idf_of[s] = int(ids[0]) % neardup.FEATURES
    df = np.zeros(neardup.FEATURES)
    for b in bag:
        for s in b:
            df[idf_of[s]] += 1
    idf = 1 + np.log((len(rows) + 1) / (df + 1)) / np.log(len(rows) + 1)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    weigh = lambda b: {s: n * min(2, max(1, idf[idf_of[s]])) for s, n in b.items()}
    weighted = [weigh(b) for b in bag]
    by_shingle = {}
    for i, b in enumerate(weighted):
        for s in b:
            by_shingle.setdefault(s, []).append(i)
    pairs = {p for v in by_shingle.values() for p in itertools.combinations(v, 2)}
    texts = {}
    for i, (_, t) in enumerate(rows):
        if (t or "") in texts:
            pairs.add((texts[t or ""], i))
        texts.setdefault(t or "", i)
    for i, j in pairs:
        a, b = weighted[i], weighted[j]
        low = sum(min(a[s], b[s]) for s in a if s in b)
        high = sum(a.values()) + sum(b.values()) - low
        if (rows[i][1] or "") == (rows[j][1] or "") or low >= similarity * high - 1e-9:
            x, y = sorted((find(rows[i][0]), find(rows[j][0])))
            root[y] = x
    return {r[0]: find(r[0]) for r in rows}


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert classes(df) == brute(rows)


def test_group_of_edits(spark):
    """Edits of one text, of which many are no neighbour of the commonest one, and a chain."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    chain = list(base)
    for i in range(30):
        chain[5 * i % 150] = f"c{i}"
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = classes(df), brute(rows)
    differ = [i for i in want if got[i] != want[i]]
    assert len(differ) <= 1


def test_small_blocks(spark, monkeypatch):
    """Groups parted into many blocks, in rows and in bytes, give the same classes."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        words = [f"v{k}" for k in range(120)]
        for at in rng.choice(120, rng.integers(0, 8), replace=False):
            words[at] = f"y{rng.integers(0, 4)}"
        rows.append((i, " ".join(words * (3 if i % 30 == 7 else 1))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block, size in ((7, 1 << 20), (256, 3_000)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
        got = classes(df)
        assert sum(got[i] != want[i] for i in want) <= 1


def test_recall_of_substitutions(spark):
    """Copies with some words changed: every one of similarity 0.8 or more is caught, and none below it.

    A changed word changes five shingles, so a share of 1 % leaves about 0.9 and one of 2 % about 0.81; the threshold of
    0.8 therefore takes all copies with 1 %, about half of those with 2 % and hardly any with 5 %.
    """
    rng, rows, recall = np.random.default_rng(3), [], {}
    for r, rate in enumerate((0.01, 0.02, 0.03, 0.05)):
        for i in range(80):
            words = [f"r{r}d{i}w{k}" for k in range(300)]
            at = 10_000 * r + 2 * i
            rows.append((at, " ".join(words)))
            rows.append((at + 1, " ".join(f"new{k}" if rng.random() < rate else w for k, w in enumerate(words))))
    got, want = classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), brute(rows)
    assert sum(got[i] != want[i] for i in want) <= 1
    for r, rate in enumerate((0.01, 0.02, 0.03, 0.05)):
        recall[rate] = np.mean([got[10_000 * r + 2 * i + 1] == got[10_000 * r + 2 * i] for i in range(80)])
    print("share of copies caught by share of words changed", recall)
    assert recall[0.01] >= 0.95 and recall[0.02] > recall[0.03] >= recall[0.05]


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (4, "!!! ...", 3), (8, "!!! ...", 3), (9, "???", 3), (1, "One two", 4), (2, "one, TWO", 4), (None, "one two", 4), (7, "x " * 30000, 4), (7, "y z", 4), (6, "y z!", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bands int")
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (4, 4), (8, 4), (9, 9), (1, 1), (2, 1), (None, None), (7, 6), (6, 6)}
    kept = neardup.dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 1, 3, 4, 6, 9]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_collisions_follow_similarity(share):
    rng = np.random.default_rng(1)
    n = 800
    k = int(2 * n * share / (1 + share))
    a = rng.integers(0, 1 << 48, n, dtype=np.uint64)
    b = np.concatenate([a[:k], rng.integers(0, 1 << 48, n - k, dtype=np.uint64)])
    wa = rng.uniform(1, 4, n)
    wb = np.concatenate([wa[:k], rng.uniform(1, 4, n - k)])
    want = wa[:k].sum() / (wa.sum() + wb.sum() - wa[:k].sum())
    s = neardup.weighted_samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, n]), 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.035
