"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are counted in numpy, trees are grown on binned statistics of a bounded sample of
labelled rows, flattened into arrays and walked for many documents at once. A score depends on the text alone.

Cases: a null text counts as empty and is scored as such; labels that are null or neither 0 nor 1 are ignored, as are
labels of unknown documents; repeated labels each count; without usable labels of both kinds every score is the share
of label 1 (0.5 without any label); a null doc_id is scored and never held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.text import pieces, word_hashes, word_spans

#: Labelled rows that a fit uses at most, those of the smallest hash.
FIT_ROWS = 20_000
THRESHOLD = 0.3

# Classes of bytes whose shares are statistics.
_CLASSES = ("other", "lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "quote", "symbol", "bracket", "high")
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate((b"", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!?", b"'\"-", b"#$%&*+=@\\^_`|~", b"()[]{}<>/", bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _i

STATISTICS = (*(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "longest_word", "short_words", "distinct_words", "top_word", "distinct_pairs", "line_words", "distinct_lines", "upper_words", "joined_words", "sentence_words")


def _by_doc(values: np.ndarray, first: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how over each document's run of values; 0 for a document without any."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = how.reduceat(values, first[full])
    return out


def _distinct(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys of each document, and how often the commonest one occurs."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    n = np.bincount(doc[new], minlength=len(first) - 1)
    most = np.zeros(len(first) - 1)
    np.maximum.at(most, doc[new], np.diff(np.append(new, len(keys))))
    return n, most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    parts = []
    for _, data, offsets in pieces(texts):
        n = len(offsets) - 1
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        counts = np.bincount(doc * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
        starts, ends, first = word_spans(data, offsets)
        hashes, length = word_hashes(data, starts, ends), ends - starts
        words = np.diff(first)
        kinds, top = _distinct(hashes, first)
        pairs = hashes * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([hashes[1:], np.zeros(min(1, len(hashes)), np.uint64)])
        pair_kinds, _ = _distinct(pairs, first)
        breaks = np.flatnonzero(data == 10)
        bounds = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
        bounds = bounds[bounds < len(data)] if len(data) else bounds[:0]
        line_first = np.searchsorted(bounds, offsets)
        lines = np.diff(line_first)
        line_kinds, _ = _distinct(word_hashes(data, bounds, np.append(bounds[1:], len(data))), line_first) if len(bounds) else (np.zeros(n), 0)
        upper = (data[starts] >= 65) & (data[starts] <= 90) & (data[np.maximum(ends - 1, starts)] >= 65) & (data[np.maximum(ends - 1, starts)] <= 90) & (length > 1)
        follows = data[np.minimum(ends, max(len(data) - 1, 0))] if len(ends) else np.zeros(0, np.uint8)
        joined = np.isin(follows, np.frombuffer(b"#$%&*!@=_", np.uint8))
        w, b = np.maximum(words, 1), np.maximum(size, 1)
        parts.append(
            np.column_stack(
                [
                    counts / b[:, None], np.log1p(size), np.log1p(words), _by_doc(length, first, np.add) / w, _by_doc(length, first, np.maximum),
                    _by_doc(length <= 3, first, np.add) / w, kinds / w, top / w, pair_kinds / w, words / np.maximum(lines, 1), line_kinds / np.maximum(lines, 1),
                    _by_doc(upper, first, np.add) / w, _by_doc(joined, first, np.add) / w, words / np.maximum(counts[:, _CLASSES.index("stop")], 1),
                ]
            )
        )
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


class Trees:
    """Boosted trees of one depth: node i of a tree has the children 2i+1 and 2i+2, and goes right above its bound."""

    def __init__(self, feature: np.ndarray, bound: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.bound, self.leaf, self.base = feature, bound, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        depth, rows, total = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0, np.arange(len(x)), np.full(len(x), self.base)
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += leaf[at - (leaf.size - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 0.5) -> Trees:
    """Logistic boosting on histograms of gradients; every split maximises the gain over quantile bins."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(np.mean(y)) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    flat = binned + np.arange(x.shape[1]) * bins
    total, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, bound, leaf, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves), np.zeros(len(y), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(at == node)
                if len(own):
                    keys = flat[own].ravel()
                    sums = [np.bincount(keys, np.repeat(v[own], x.shape[1]), x.shape[1] * bins).reshape(-1, bins).cumsum(1) for v in (g, h)]
                    gl, hl, ga, ha = sums[0][:, :-1], sums[1][:, :-1], g[own].sum(), h[own].sum()
                    gain = np.where((hl >= least) & (ha - hl >= least), gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge), 0)
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        feature[node], bound[node] = f, cuts[f][b]
                    at[own] = 2 * node + 1 + (x[own, feature[node]] > bound[node])
        at -= inner
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf = rate * gs / (hs + ridge)
        total += leaf[at]
        for kept, new in zip(out, (feature, bound, leaf), strict=True):
            kept.append(new)
    return Trees(*map(np.array, out), base)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _arrow_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch["text"])
        yield pa.record_batch([batch["key"], batch["label"], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))], ["key", "label", "x"])


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees:
    """Trees from at most fit_rows labelled documents that aren't held out, those of the smallest hash of doc_id and text."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and _id is not null").where(~held_out("_id"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id", "label").limit(fit_rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # fit_rows bounds the broadcast
    rows = texts.select(F.xxhash64("_id", "text").alias("key"), "label", "text").mapInArrow(_arrow_statistics, "key long, label int, x array<double>")
    rows = rows.orderBy("key", "label").limit(fit_rows).toPandas()  # several documents may share a labelled id
    if not len(rows):
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def scored(documents: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """documents' doc_id, held_out, score and predicted; one pass, no shuffle."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = trees.score(statistics(batch["text"]))
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def quality(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every document for quality, with trees learnt from labels."""
    return scored(documents, learn(documents, labels, fit_rows), threshold)
