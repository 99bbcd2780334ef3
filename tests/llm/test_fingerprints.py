"""Fingerprints: edited texts and neighbours by brute force, and likeness against generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

import numpy as np

from folium.llm import fingerprints as f


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^\W_]+", x.lower())) for x in (a, b))
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both) if both else 1.0


def check(rows, got):
    rows = sorted((d, t or "") for d, t in rows if d is not None)
    got = sorted(got, key=lambda r: (r["doc_id"], r["n_chars"], r["edited_sha256"]))
    off, by_text, want = [], {}, []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    want.sort(key=lambda x: x[:3])
    for (d, n, sha, t, edited, after), r in zip(want, got, strict=True):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, n, sha)
        for text, print_ in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert by_text.setdefault(text, print_) == print_ and len(print_) == 4 * f.SAMPLES
        off += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
    return np.array(off)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    off = check([(r["doc_id"], r["text"]) for r in df.collect()], f.fingerprints(df.repartition(3)).collect())
    assert abs(off.mean()) < 0.01 and off.std() < 0.06 and abs(off).max() < 0.3


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (7, "one", 3), (7, "one", 3), (7, "Two words", 3), (2**62, "é ß 中文 x" * 400, 4), (-(2**62), "a b c d", 4), (None, "lost", 4), (8, "!!", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int")
    check([r[:2] for r in rows], f.fingerprints(df).collect())


def test_one_and_none(spark):
    df = spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")
    row = f.fingerprints(df).collect()[0]
    assert row["near_next"] == 1.0 and 0 < row["near_edited"] < 1
    assert f.fingerprints(df.where("false")).count() == 0


def test_weights(spark):
    """Counts, not only sets: similarity of weights far apart."""
    rows = []
    for i in range(60):
        rows.append((2 * i, " ".join([f"a{i}"] * 6 + [f"b{i}"] * 2 + [f"c{i}"] * 1)))
        rows.append((2 * i + 1, " ".join([f"a{i}"] * 2 + [f"b{i}"] * 6 + [f"d{i}"] * 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near = [r["near_next"] for r in f.fingerprints(df).collect() if r["doc_id"] % 2 == 0]
    assert abs(np.mean(near) - 4 / 14) < 0.03


def test_long_texts(spark):
    """20,000 words with the second half drawn anew: the mean likeness is the generalised Jaccard similarity."""
    rng, rows = np.random.default_rng(11), []
    for i in range(8):
        words = [f"w{x}" for x in rng.zipf(1.15, 30_000) % 40_000]
        rows += [(2 * i, " ".join(words[:20_000])), (2 * i + 1, " ".join(words[:10_000] + words[20_000:]))]
    got = {r["id"]: np.array(r["samples"]) for r in f.samples(spark.createDataFrame(rows, "id long, text string"), ["id"], 512).collect()}
    off = [np.mean(got[2 * i] == got[2 * i + 1]) - jaccard(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(8)]
    assert abs(np.mean(off)) < 0.02, off


def test_draws():
    """Both tables against the distribution of Gamma(2, 1), tails included."""
    below = lambda x: 1 - (1 + x) * np.exp(-x)
    n = f.QUANTILES
    part = (np.arange(n) + 0.5) / n
    r, c = f._gamma_quantiles(first=False), f._gamma_quantiles(first=True)
    assert np.allclose(below(r[:n]), part, atol=1e-9) and np.allclose(below(c[:n]), part, atol=1e-9)
    assert np.allclose(1 - below(r[n:]), (1 - part) / n, rtol=1e-6) or np.allclose(1 - below(r[n:]), part / n, rtol=1e-6)
    assert np.allclose(below(c[n:]), part / n, rtol=1e-4)


def test_blocks_follow_the_text(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    before = f.neighbours(df).select("block").distinct().count()
    monkeypatch.setattr(f, "BLOCK_TEXT_BYTES", 5_000)
    assert f.neighbours(df).select("block").distinct().count() > before
