"""Packing: every id in exactly one piece, gapless sequences, little padding; the subset sum against brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folium.llm import packing, tokens


def whole(rows, texts, capacity=2048):
    """Asserts all that the pieces promise; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    encode = tokens.encoder(packing.VOCABULARY).whole.encode
    for doc_id, text in texts.items():
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    size, padded = 0, 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        size += at
        padded += 0 if at & (at - 1) == 0 else capacity - at
    return padded / max(1, size)


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert whole(packing.pack(df.repartition(3)).collect(), texts) == 0
    assert whole(packing.pack(df.coalesce(1), window_tokens=5000).collect(), texts) == 0


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 9000, "c"), (None, "x", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").coalesce(1)
    out = packing.pack(df).collect()
    assert whole(out, {r[0]: r[1] for r in rows}) == 0
    assert packing.pack(df.where("false")).count() == 0


def test_repeated_ids(spark):
    """Rows of one doc_id are packed each on its own: pieces are whole for every text."""
    texts = ["same " * 50, "same " * 50, "other words " * 1500]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, capacity=512).collect()
    encode = tokens.encoder(packing.VOCABULARY).whole.encode
    sizes = sorted(len(encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    by_size = defaultdict(int)
    for r in rows:
        by_size[r["doc_tokens"]] += r["length"]
    assert dict(by_size) == {sizes[0]: 2 * sizes[0], sizes[2]: sizes[2]}


@pytest.mark.parametrize("seed", range(40))
def test_fill_is_best(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 40), rng.randint(1, 5))
    counts = [rng.randint(1, 4) for _ in lengths]
    capacity = rng.randint(5, 90)
    found = dict(packing.fill(zip(lengths, counts), capacity))
    assert set(found) <= set(lengths)
    taken = [found.get(x, 0) for x in lengths]
    sums = {sum(n * x for n, x in zip(ns, lengths)) for ns in itertools.product(*(range(c + 1) for c in counts))}
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert sum(t * x for t, x in zip(taken, lengths)) == max(s for s in sums if s <= capacity)


def test_windows_are_filled():
    rng = random.Random(3)
    packer, pieces = packing.Packer(), []
    lengths = [int(rng.paretovariate(0.8) * 60) for _ in range(3000)]
    for i, n in enumerate(lengths):
        pieces += packer.add(i, n)
    pieces += packer.windows()
    cut = sum(1 for p in pieces if p[2] < 2048) - sum(1 for n in lengths if n % 2048)
    assert cut <= 5  # nearly every window is filled by whole remainders
    pieces += packer.end()
    assert sum(p[2] for p in pieces) == sum(lengths)
