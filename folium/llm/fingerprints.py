"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its lower-cased words, weighted by how often they occur. For each of SAMPLES samples and each
term, a hash of both draws r and c from Gamma(2, 1), by a table of quantiles, and b from U(0, 1); a term of weight w has
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1), and the term with the least a gives the sample, 16 bits of a
hash of (term, t). Two documents agree in a sample with a probability that is the generalised Jaccard similarity of
their weights but for the steps of the table; likeness() is the share of samples that agree. The least a of a long text
comes from the least c and the greatest r, so that one of the table's QUANTILES parts is itself parted into as many.

neighbours() brings each document and its successor by doc_id together with one shuffle of the texts: ranges of doc_id
are dealt out as blocks, and each block also gets a copy of the next block's first document.

Cases: a null text counts as empty; a text without words has samples of zeros, so that all such texts are alike (1.0)
and unlike others; equal texts have equal fingerprints; rows without doc_id are left out; repeated doc_ids are ordered
by text and each gets a row; the only document's next one is itself; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 64
TOGETHER = 8  # samples that one pass over a term computes
QUANTILES = 1024
BLOCK_TEXT_BYTES = 512 << 20  # of text in a block at most, so that the number of blocks grows with the input


def _gamma_quantiles(first: bool, n: int = QUANTILES) -> np.ndarray:
    """The middle of each of n equal parts of Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x), then those of n equal parts
    of the first part, or of the last."""
    part = (np.arange(n) + 0.5) / n
    over = np.concatenate([1 - part, 1 - part / n if first else part / n])
    low, high = np.zeros(2 * n), np.full(2 * n, 80.0)
    for _ in range(80):
        x = (low + high) / 2
        below = (1 + x) * np.exp(-x) > over
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """A constant array, folded when the query is planned."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def weighted_terms(text: str) -> list[tuple[str, Column]]:
    """Steps, each a column's name and expression, that turn the column text into `terms`: (term, ln of its count)."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: (i == 0) | (F.get("hashes", i) != F.get("hashes", F.greatest(i - 1, F.lit(0)))))
    counted = F.transform("runs", lambda at, i: F.struct(F.get("hashes", at).alias("term"), F.ln((F.coalesce(F.get("runs", i + 1), F.size("hashes")) - at).cast("double")).alias("ln")))
    return [("hashes", F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))), ("runs", F.when(F.size("hashes") > 0, runs).otherwise(F.array().cast("array<int>"))), ("terms", counted)]


def _sample(j: int, r: Column, lnc: Column) -> Column:
    """A long whose order is that of ln a and whose low 16 bits are the sample's value."""
    h = F.xxhash64(F.col("hash").bitwiseXOR(F.lit(j)))
    low = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(QUANTILES - 1)).cast("int")
    at = lambda shift, parted: F.when(low(shift) == parted, low(shift + 10) + QUANTILES).otherwise(low(shift))
    b = (low(40) + F.lit(0.5)) / F.lit(float(QUANTILES))
    own_r = F.get(r, at(0, QUANTILES - 1))
    t = F.when(F.col("ln") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("ln") / own_r + b))  # most terms occur once
    a = F.get(lnc, at(20, 0)) - own_r * (t - b + F.lit(1.0))
    value = F.shiftrightunsigned(h, 48).bitwiseXOR((t * F.lit(40503)).bitwiseAND(F.lit(0xFFFF)))
    return F.shiftleft(((a + F.lit(1024.0)) * F.lit(float(1 << 32))).cast("long"), 16).bitwiseOR(value)


def samples(rows: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys and samples (an array of n values) of rows (keys, text). Rows of one key must be rows of one document."""
    tables = _table(_gamma_quantiles(first=False)), _table(np.log(_gamma_quantiles(first=True)))
    for name, column in weighted_terms("text"):
        rows = rows.withColumn(name, column)
    each = rows.select(*keys, F.explode_outer("terms").alias("x")).select(*keys, "x.term", "x.ln")
    parts = each.select(*keys, "term", "ln", F.explode(F.sequence(F.lit(0), F.lit(n // TOGETHER - 1))).alias("part"))
    parts = parts.select(*keys, "term", "ln", "part", F.xxhash64("term", "part").alias("hash"))
    least = parts.groupBy(*keys, "part").agg(*(F.min(F.when(F.col("term").isNotNull(), _sample(j, *tables))).alias(f"s{j}") for j in range(TOGETHER)))
    values = F.array(*(F.coalesce(F.col(f"s{j}"), F.lit(0)).bitwiseAND(F.lit(0xFFFF)).cast("int") for j in range(TOGETHER)))
    joined = least.select(*keys, F.struct("part", values.alias("values")).alias("x")).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return joined.select(*keys, F.flatten(F.transform("x", lambda x: x["values"])).alias("samples"))


def fingerprint(values: Column) -> Column:
    """The samples as one string of hexadecimal digits."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a).cast("double")


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _block(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are under doc_id: those of lower cells, and those of its own that are."""
    if not cuts:
        return F.lit(0)
    cells = 4 * len(cuts)
    low, width = float(cuts[0]), max((float(cuts[-1]) - float(cuts[0])) / cells, 1e-300)
    cell_of = lambda x: int(min(max(np.floor((float(x) - low) / width), 0), cells - 1))
    held = np.bincount([cell_of(c) for c in cuts], minlength=cells)
    before, held = _longs((np.cumsum(held) - held).tolist()), _longs(held.tolist())
    cell = F.least(F.greatest(F.floor((doc_id.cast("double") - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(cells - 1)).cast("int")
    own = F.slice(_longs(cuts), (F.get(before, cell) + 1).cast("int"), F.get(held, cell).cast("int"))
    return (F.get(before, cell) + F.size(F.filter(own, lambda c: c < doc_id))).cast("int")


def neighbours(documents: DataFrame) -> DataFrame:
    """(block, at, extra, doc_id, text, next_text) in ascending (doc_id, text) of each block; the last row's next is the first.

    extra marks a copy that only stands after its block's last document.
    """
    rows = documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(8 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_TEXT_BYTES))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0]
    rows = rows.withColumn("block", _block(F.col("doc_id"), sorted(set(cuts or []))))
    heads = sorted(tuple(r) for r in rows.groupBy("block").agg(F.min("doc_id")).collect())  # one row for each block
    head, before = {b: h for b, h in heads}, {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    top = max(head, default=0)
    # A block without documents has no head; its entry is never read.
    first = F.col("doc_id") == F.get(_longs([head.get(b, 0) for b in range(top + 1)]), F.col("block"))
    previous = F.get(_longs([before.get(b, 0) for b in range(top + 1)]), F.col("block")).cast("int")
    here = F.struct(F.col("block"), F.lit(0).alias("extra"))
    to = F.when(first, F.array(here, F.struct(previous.alias("block"), F.lit(1).alias("extra")))).otherwise(F.array(here))
    dealt = rows.select("doc_id", "text", F.explode(to).alias("to")).select("to.block", "to.extra", "doc_id", "text")
    order = Window.partitionBy("block").orderBy("extra", "doc_id", "text")
    return dealt.select("block", F.row_number().over(order).alias("at"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(documents: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document.

    The edited text has its last half (rounded down) replaced by as many code points of the next text's start.
    """
    rows = neighbours(documents).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.withColumn("edited", F.when(F.col("extra") == 0, edited))
    own = F.struct(F.lit(0).alias("which"), F.col("text"), F.lit("").alias("sha"))
    other = F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    both = F.when(F.col("extra") == 0, F.array(own, other)).otherwise(F.array(own))
    keys = ["block", "at", "which", "extra", "doc_id", "n_chars", "sha"]
    texts = rows.select("block", "at", "extra", "doc_id", "n_chars", F.explode(both).alias("x")).select("block", "at", "x.which", "extra", "doc_id", "n_chars", "x.sha", "x.text")
    order = Window.partitionBy("block").orderBy("at", "which")
    found = samples(texts, keys, n).select("*", F.lead("samples", 1).over(order).alias("a"), F.lead("samples", 2).over(order).alias("b"), F.lead("sha", 1).over(order).alias("edited_sha256"))
    found = found.where("which = 0 and extra = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("samples")).alias("fingerprint"), fingerprint(F.col("a")).alias("edited_fingerprint"), likeness(F.col("samples"), F.col("a")).alias("near_edited"), likeness(F.col("samples"), F.col("b")).alias("near_next"))
