"""Connected components and greedy independent sets of many runs at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.sources.store import Steps, saved

BLOCK_IDS = 2000  # consecutive ids that a task settles in order


def components(edges: DataFrame, keys: list[str], name: str = "components") -> DataFrame:
    """(keys, id, root) for every id in edges (keys, a, b); root is the smallest id reached within the same keys.

    Large-star and small-star steps: each hangs neighbours onto the smallest one seen, so long chains shrink by steps
    that grow with the logarithm of their length. A step's table is written in place of the last one, and only a count comes to the driver.
    """
    pair = edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    steps = Steps(edges.sparkSession, name)
    pair, before = steps.put(pair), None
    while True:
        now = tuple(pair.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = pair.unionByName(pair.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        least = least.withColumn("m", F.least("u", "m"))
        large = both.join(least, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
        pair = steps.put(small.where("u <> v").distinct())
    leaves = pair.groupBy(*keys, F.col("u").alias("id")).agg(F.min("v").alias("root"))
    return leaves.unionByName(pair.select(*keys, F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def greedy_first(held: DataFrame, keys: list[str], name: str = "greedy") -> DataFrame:
    """(keys, id) kept from held (keys, id, key), taking ids in ascending order unless a kept one holds one of its keys.

    A round keeps every row that is the first undecided one of all its keys and drops the others that hold these keys, so
    a key of n rows costs n, not pairs; the number of rounds is that of the longest chain of decisions.
    """
    steps = Steps(held.sparkSession, name)
    left, kept = steps.put(held.select(*keys, "id", "key").distinct()), None
    while not left.isEmpty():
        first = left.groupBy(*keys, "key").agg(F.min("id").alias("first"))
        new = saved(left.join(first, [*keys, "key"]).groupBy(*keys, "id").agg(F.min((F.col("id") == F.col("first")).cast("int")).alias("all")).where("all = 1").select(*keys, "id"), name)
        taken = left.join(new, [*keys, "id"], "left_semi").select(*keys, "key").distinct()
        gone = left.join(taken, [*keys, "key"], "left_semi").select(*keys, "id").distinct()
        left = steps.put(left.join(gone, [*keys, "id"], "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
    return held.select(*keys, "id").limit(0) if kept is None else kept


def _settle(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """The decisions of some blocks of ids, in order: rows (keys, id, hit, waits, near), near being undecided ids of a row's block."""
    kept: dict[tuple, bool | None] = {}
    frame = frame.sort_values("id")
    for i, hit, waits, near, *key in zip(*(frame[c].tolist() for c in ("id", "hit", "waits", "near", *keys)), strict=True):
        before = [kept[x, *key] for x in near]
        kept[i, *key] = False if hit or True in before else None if waits or None in before else True
    decided = [kept[x] for x in zip(*(frame[c].tolist() for c in ("id", *keys)), strict=True)]
    return frame[[*keys, "id"]].assign(kept=pd.array(decided, dtype="boolean"))


def greedy_keep(rows: DataFrame, conflicts: DataFrame, keys: list[str], name: str = "greedy", block: int = BLOCK_IDS) -> DataFrame:
    """Rows (keys, id) with kept, taking ids in ascending order unless an earlier kept one conflicts (keys, a, b).

    Rows without conflicts are kept at once. Of the others, a round first lets decided rows drop their later neighbours, and
    keeps those without an undecided earlier one. Then each block of `block` consecutive ids that has conflicts inside is gone
    through in order, which settles every row whose undecided neighbours are all of its block and settled before it. So a chain
    costs a round for each block that it crosses, and a task takes small blocks together, about `block` rows at a time.
    """
    number = lambda c: F.floor(F.col(c) / block)
    distinct = conflicts.select(*keys, F.greatest("a", "b").alias("id"), F.least("a", "b").alias("early")).where("id <> early").distinct()
    back = saved(distinct.withColumn("near", number("id") == number("early")), name)
    if back.isEmpty():
        return rows.select(*keys, "id", F.lit(True).alias("kept"))
    bound = saved(back.select(*keys, "id").unionByName(back.select(*keys, F.col("early").alias("id"))).distinct(), name)
    free = rows.select(*keys, "id").join(bound, [*keys, "id"], "left_anti").withColumn("kept", F.lit(True))
    steps, lefts = Steps(rows.sparkSession, name), Steps(rows.sparkSession, f"{name}-left")
    state = steps.put(rows.select(*keys, "id").join(bound, [*keys, "id"], "left_semi").withColumn("kept", F.lit(None).cast("boolean")))
    while not state.where("kept is null").isEmpty():
        early = state.select(*keys, F.col("id").alias("early"), F.col("kept").alias("early_kept"))
        waits = F.col("early_kept").isNull()
        seen = back.join(early, [*keys, "early"]).groupBy(*keys, "id").agg(F.max(F.coalesce("early_kept", F.lit(False))).alias("hit"), F.max(waits & ~F.col("near")).alias("waits"), F.collect_set(F.when(waits & F.col("near"), F.col("early"))).alias("near"))
        left = state.where("kept is null").join(seen, [*keys, "id"], "left").select(*keys, "id", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("waits", F.lit(False)).alias("waits"), F.coalesce("near", F.array().cast(seen.schema["near"].dataType)).alias("near"), number("id").alias("block"))
        left = lefts.put(left.withColumn("inside", F.max(F.size("near")).over(Window.partitionBy(*keys, "block")) > 0))
        alone = left.where("not inside").select(*keys, "id", F.when(F.col("hit"), False).when(~F.col("waits"), True).alias("kept"))
        inside = left.where("inside")
        deal = F.pmod(F.xxhash64(*keys, "block"), F.lit(inside.count() // block + 1))
        settled = inside.withColumn("deal", deal).groupBy("deal").applyInPandas(lambda frame: _settle(frame, keys), state.schema)
        state = steps.put(state.where("kept is not null").unionByName(alone).unionByName(settled))
    return free.unionByName(state)
