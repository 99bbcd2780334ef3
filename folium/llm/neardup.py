"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF word shingles, banded, then verified.

1. Document frequencies of shingles, hashed to FEATURES counters, are summed over all documents; the weight of a shingle
   in a document is tf * idf with idf = 1 + ln((N + 1) / (df + 1)) / ln(N + 1), which lies between 1 and 2 for any N.
2. Each distinct text gets BANDS * ROWS weighted samples; two texts of generalised Jaccard similarity s agree in one
   with probability s, so they share a band with probability 1 - (1 - s**ROWS)**BANDS (0.9998 at 0.8).
3. In each band's bucket only the most central text, the hub, is compared with the others, by exact weighted Jaccard.
4. Where a bucket still holds several components, the texts that the hub's component lacks are compared with all others
   of the bucket's group, in blocks; a block sends on the links of a spanning forest only. So every pair that shares a
   bucket is either compared or already known to be connected, and no group's pairs are emitted. What is sent to the
   blocks is a text's sorted 32-bit shingle hashes, made once for each candidate, and blocks are bounded in rows and bytes.
5. Classes are the connected components of the links; class_id is the smallest doc_id.

Cases: a null text counts as empty; texts without any word are in one class with equal texts only; equal texts always
share a class; several rows of one doc_id are one document (their classes join); rows without doc_id keep a null
class_id; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators.components import components
from folium.sources.store import saved
from folium.llm.text import mix, shingled

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
FEATURES = 1 << 18
BLOCK, BLOCK_BYTES = 256, 8 << 20  # texts of one side that a verifying group holds, and their shingles' bytes, on average
_PIECES = 64
_POOL = 1 << 16


def _pool() -> tuple[np.ndarray, ...]:
    """Draws that a sample's hash picks from: 1/r, r, beta and ln(c) with r, c ~ Gamma(2, 1) and beta ~ U(0, 1)."""
    rng = np.random.default_rng(20_11)
    r, c, beta = rng.gamma(2, 1, _POOL), rng.gamma(2, 1, _POOL), rng.random(_POOL)
    return tuple(x.astype(np.float32) for x in (1 / r, r, beta, np.log(c)))


_DRAWS: list[tuple[np.ndarray, ...]] = []


def weighted_samples(ids: np.ndarray, weights: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """n samples for each run of ids that starts at first: 32-bit hashes of (element, step of its weight).

    For an element of weight w: t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the least a wins.
    """
    if not _DRAWS:
        _DRAWS.append(_pool())
    inverse, r, beta, lnc = _DRAWS[0]
    ln = np.log(weights).astype(np.float32)
    base = mix(ids)
    out = np.empty((len(first), n), np.uint32)
    for j in range(n):
        h = base * np.uint64(2 * 0x51_7C_C1_B7_27_22_0A95 + 1 + 2 * j * 0x9E37_79B9 & (1 << 64) - 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        pick = (h >> np.uint64(48)).astype(np.intp)
        b = beta[pick]
        t = np.floor(ln * inverse[pick] + b)
        a = lnc[pick] - r[pick] * (t - b + np.float32(1))
        bits = a.view(np.int32)
        order = (bits ^ ((bits >> np.int32(31)) | np.int32(-(1 << 31)))).view(np.uint32)
        same = (h & np.uint64(0xFFFFFFFF)) ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
        out[:, j] = (np.minimum.reduceat((order.astype(np.uint64) << np.uint64(32)) | same, first) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _feature(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(FEATURES - 1)).astype(np.int64)


def inverse_frequencies(documents: DataFrame) -> np.ndarray:
    """idf of each hashed shingle over all documents: FEATURES numbers, however large the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, shingle, _ in shingled(batch["text"]):
                df += np.bincount(_feature(shingle), minlength=FEATURES)
        if n:
            parts = [p.tobytes() for p in df.reshape(_PIECES, -1)]
            yield pa.record_batch([pa.array(range(_PIECES), pa.int32()), pa.array([n] * _PIECES, pa.int64()), pa.array(parts, pa.binary())], ["piece", "n", "df"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES // _PIECES, np.int64)
        for batch in rows:
            n += sum(batch["n"].to_pylist())
            for part in batch["df"]:
                df += np.frombuffer(part.as_buffer(), np.int64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["piece", "n", "df"])

    schema = "piece int, n long, df binary"
    rows = documents.select("text").mapInArrow(count, schema).groupBy("piece").applyInArrow(add, schema).collect()
    df = np.zeros((_PIECES, FEATURES // _PIECES))
    for row in rows:
        df[row["piece"]] = np.frombuffer(row["df"], np.int64)
    n = rows[0]["n"] if rows else 0
    return (1 + np.log((n + 1) / (df.ravel() + 1)) / np.log(max(n, 1) + 1)).clip(1, 2).astype(np.float32)


def signatures(documents: DataFrame, idf: Broadcast, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, t1, t2, bands): a hash of the text, and a hash of each band of samples (none without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], np.zeros(batch.num_rows, np.int64)
            for row, _, doc, shingle, times in shingled(batch["text"]):
                if len(doc):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    samples = weighted_samples(shingle, times * idf.value[_feature(shingle)], first, bands * rows)
                    wide = samples.astype(np.uint64).reshape(len(first), bands, rows)
                    key = np.zeros((len(first), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        key = mix(key + wide[:, :, j] + np.uint64(0x9E3779B97F4A7C15))
                    keys.append(key.view(np.int64).ravel())
                    sizes[row + doc[first]] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.record_batch([batch["doc_id"], batch["t1"], batch["t2"], lists], ["doc_id", "t1", "t2", "bands"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows_in = documents.select("doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("folium"), text).alias("t2"), "text").where("doc_id is not null")
    return rows_in.mapInArrow(sign, "doc_id long, t1 long, t2 long, bands array<long>")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of links that join two trees when taken in order."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def shingle_lists(texts: DataFrame) -> DataFrame:
    """(id, shingles, size) of texts (id, text): the low 32 bits of each shingle as often as it occurs, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = [], np.zeros(batch.num_rows, np.int64)
            for row, n, doc, shingle, times in shingled(batch["text"]):
                keys = np.repeat(doc.astype(np.uint64) << np.uint64(32) | shingle & np.uint64(0xFFFFFFFF), times)
                keys.sort()
                sizes[row : row + n] = 4 * np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)
                lists.append(keys.astype("<u4"))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            data = np.concatenate(lists) if lists else np.zeros(0, "<u4")
            found = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.record_batch([batch["id"], found, pa.array(sizes, pa.int64())], ["id", "shingles", "size"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary, size long")


def verified(groups: DataFrame, lists: DataFrame, idf: Broadcast, similarity: float) -> DataFrame:
    """Links (a, b) of weighted Jaccard similarity from each group's left rows to its right ones.

    groups: (hub, yb, xb, id, is_left), a block of each side; a group's links are thinned to a spanning forest.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, left = table["id"].to_numpy(), table["is_left"].to_numpy()
        own = [np.frombuffer(x.as_buffer(), "<u4") for x in table["shingles"]]
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in own])
        keys = doc.astype(np.uint64) << np.uint64(32) | np.concatenate(own)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        doc, shingle, times = doc[new], keys[new] & np.uint64(0xFFFFFFFF), np.diff(np.append(new, len(keys)))
        weight = times * idf.value[_feature(shingle)].astype(np.float64)
        total = np.bincount(doc, weight, len(ids))
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        right = ~left[doc]
        order = np.argsort(shingle[right], kind="stable")
        there, holder, theirs = shingle[right][order], doc[right][order], weight[right][order]
        pairs = []
        for y in np.flatnonzero(left):
            mine, w = shingle[bounds[y] : bounds[y + 1]], weight[bounds[y] : bounds[y + 1]]
            lo, hi = np.searchsorted(there, mine), np.searchsorted(there, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(holder[at], np.minimum(np.repeat(w, n), theirs[at]), len(ids))
            x = np.flatnonzero(common >= similarity * (total + total[y] - common) - 1e-9)
            x = x[(common[x] > 0) & (ids[x] != ids[y])]
            pairs.append((np.full(len(x), ids[y]), ids[x]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (ids[:0], ids[:0])
        kept = _forest(a, b)
        return pa.table({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64())})

    rows = groups.join(lists.select("id", "shingles"), "id")
    return rows.groupBy("hub", "yb", "xb").applyInArrow(compare, "a long, b long")


def _blocks(n, size) -> F.Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")


def _block_of(id_, blocks) -> F.Column:
    return F.pmod(F.xxhash64(id_), blocks).cast("int")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id), a row for each row of documents."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    idf = spark.sparkContext.broadcast(inverse_frequencies(documents))
    signed = saved(signatures(documents, idf, bands, rows), "signatures")
    texts = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    texts = saved(texts, "distinct-texts")
    single = signed.groupBy("doc_id").agg(F.min("t1").alias("x"), F.max("t1").alias("y")).where("x <> y").select(F.col("doc_id").alias("again"))
    aliases = signed.join(single, signed["doc_id"] == single["again"]).join(texts.select("t1", "t2", "id"), ["t1", "t2"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    buckets = texts.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(buckets.join(shared, "bucket"), "band-members")
    central = members.groupBy("id").agg(F.sum("n").alias("c"))
    hubs = members.join(central, "id").groupBy("bucket").agg(F.max_by("id", F.struct("c", -F.col("id"))).alias("hub"))
    stars = saved(members.join(hubs, "bucket").select("hub", "id").distinct().where("hub <> id"), "stars")
    wanted = stars.select("id").union(stars.select("hub")).distinct()
    # The same join at every size: texts are shuffled once, whether or not the candidates' ids would fit a broadcast.
    texts_of = documents.join(wanted.hint("merge"), documents["doc_id"] == wanted["id"]).select("id", "text")
    needed = saved(shingle_lists(texts_of), "candidate-shingles")
    stars = saved(stars.join(needed.select("id", "size"), "id"), "sized-stars")

    n = stars.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    zero = F.lit(0)
    right = stars.join(n, "hub").select("hub", zero.alias("yb"), _block_of(F.col("id"), F.col("blocks")).alias("xb"), "id", F.lit(False).alias("is_left"))
    left = n.select("hub", zero.alias("yb"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("xb"), F.col("hub").alias("id"), F.lit(True).alias("is_left"))
    links = saved(verified(left.unionByName(right), needed, idf, similarity), "star-links").unionByName(aliases)

    label = components(links, [])
    named = stars.join(label, "id", "left").select("hub", "id", "size", F.coalesce("root", "id").alias("root"))
    hub_label = label.select(F.col("id").alias("hub"), F.col("root").alias("hub_root"))
    named = named.join(hub_label, "hub", "left").select("hub", "id", "size", (F.col("root") != F.coalesce("hub_root", "hub")).alias("outside"))
    outside = F.when(F.col("outside"), F.col("size"))
    open_ = named.groupBy("hub").agg(F.count("*").alias("nx"), F.count_if("outside").alias("ny"), F.sum("size").alias("sx"), F.sum(outside).alias("sy")).where("ny > 0 and nx > 1")
    open_ = open_.select("hub", _blocks(F.col("nx"), F.col("sx")).alias("bx"), _blocks(F.col("ny"), F.col("sy")).alias("by"))
    rest = saved(named.join(open_, "hub"), "open-groups")
    xs = rest.select("hub", F.explode(F.sequence(zero, F.col("by") - 1)).alias("yb"), _block_of(F.col("id"), F.col("bx")).alias("xb"), "id", F.lit(False).alias("is_left"))
    ys = rest.where("outside").select("hub", _block_of(F.col("id"), F.col("by")).alias("yb"), F.explode(F.sequence(zero, F.col("bx") - 1)).alias("xb"), "id", F.lit(True).alias("is_left"))
    more = saved(verified(xs.unionByName(ys), needed, idf, similarity), "open-links")

    label = components(links.unionByName(more), [])
    classes = texts.join(label, "id", "left").select("t1", "t2", F.coalesce("root", "id").alias("class_id"))
    found = signed.select("doc_id", "t1", "t2").join(classes, ["t1", "t2"]).select("doc_id", "class_id")
    lost = documents.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(lost)


def dedup(documents: DataFrame, **options) -> DataFrame:
    """documents without the rows of all but the smallest doc_id of each class; rows without doc_id stay."""
    repeated = near_duplicates(documents, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_repeat")).distinct()
    return documents.join(repeated, documents["doc_id"] == repeated["_repeat"], "left_anti")
