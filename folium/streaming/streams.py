"""Progress events, caches and incremental intake as streams, each with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from folium.operators.components import components
from folium.operators.fusion import identity_keys
from folium.sources.buckets import BUCKET_ROWS, BUCKETS, Buckets
from folium.sources.store import Steps, append, saved

FEED, TTL_SECONDS = 100, 14_400
TERMINAL = ("completed", "failed")


def latest_progress(events: DataFrame) -> DataFrame:
    """The last event (run_id, ts, seq, event_type, value) of each run, and whether it ends the run; batch or stream."""
    last = F.max_by(F.struct("event_type", "value", "ts", "seq"), F.struct("ts", "seq"))
    return events.groupBy("run_id").agg(last.alias("e"), F.count("*").alias("n")).select("run_id", "e.event_type", "e.value", "e.ts", "n", F.col("e.event_type").isin(*TERMINAL).alias("terminal"))


def keep_latest(stream: DataFrame, path: str, checkpoint: str):
    """S1's sink: each micro-batch's changed runs are appended with the batch's number; latest() reads them."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: append(df.withColumn("batch", F.lit(i)), path)).start()


def bounded_feed(events: DataFrame, n: int = FEED) -> DataFrame:
    """The newest n events of each run, oldest dropped."""
    order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("age", F.row_number().over(order)).where(F.col("age") <= n)


def bounded_feed_stream(events: DataFrame, n: int = FEED) -> DataFrame:
    """S2 as a stream: each micro-batch gives the changed runs' feeds (run_id, age, ts, seq, event_type); n events of state a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(dict(zip(("ts", "seq", "event_type"), state.get))) if state.exists else pd.DataFrame({"ts": [], "seq": [], "event_type": []})
        for frame in frames:
            new = frame[["ts", "seq", "event_type"]]
            kept = (pd.concat([kept, new]) if len(kept) else new).sort_values(["ts", "seq"], ascending=False).head(n)
        state.update((kept["ts"].astype("int64").tolist(), kept["seq"].astype("int64").tolist(), kept["event_type"].tolist()))
        yield pd.DataFrame({"run_id": key[0], "age": range(1, len(kept) + 1), "ts": kept["ts"].tolist(), "seq": kept["seq"].tolist(), "event_type": kept["event_type"].tolist()})

    schema = "run_id long, age int, ts long, seq long, event_type string"
    return events.select("run_id", F.col("ts").cast("long").alias("ts"), "seq", "event_type").groupBy("run_id").applyInPandasWithState(step, schema, "ts array<long>, seq array<long>, event_type array<string>", "update", GroupStateTimeout.NoTimeout)


def stalled_runs(events: DataFrame, seconds: int) -> DataFrame:
    """S3: runs without an end whose last event is more than `seconds` before the newest of all: they count as failed."""
    now = events.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]  # one number
    last = latest_progress(events)
    idle = F.lit(now) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return last.where(~F.col("terminal") & (idle > seconds)).select("run_id", "event_type", idle.alias("idle"), F.lit("failed").alias("status"))


def stalled_runs_stream(events: DataFrame, seconds: int, watermark: str = "10 seconds") -> DataFrame:
    """S3 as a stream: a run without an event for `seconds` of event time, and without an end, is given once as failed."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["failed"]})
            return
        last: Any = state.get[0] if state.exists else -1
        over = False
        for frame in frames:
            last = max(last, int(frame["at"].max()))
            over |= bool(frame["event_type"].isin(TERMINAL).any())
        if over:
            state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("ts", watermark).withColumn("at", F.col("ts").cast("long"))
    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def cache_key(source, operation, params: dict[str, Column], version: str = "v1") -> Column:
    """The key of a request: its source, operation and version, and a hash of its parameters by name.

    Names are ordered; values stand as they are, nulls included, so different requests have different keys. A request
    without source or operation has no key.
    """
    named = F.struct(*(params[name].alias(name) for name in sorted(params)))
    payload = F.to_json(F.struct(F.lit(version).alias("adapter_version"), named.alias("params")), {"ignoreNullFields": "false"})
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat(column(source), F.lit(":"), column(operation), F.lit(f":{version}:"), F.sha2(payload.cast("binary"), 256))


def cache_hits(requests: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Requests (key, t, ...) with hit: within ttl seconds of the miss that filled the cache; a hit doesn't extend it.

    A request without key or time is a miss that fills nothing. A key's misses are its first request and, from each on, the
    first one ttl later. They are found by pointer doubling: every step doubles the distance that known misses reach, so
    steps grow with the logarithm of misses a key.
    """
    keyed = F.col("key").isNotNull() & F.col("t").isNotNull()
    times = requests.where(keyed).select("key", "t").distinct()
    # Each time t asks for the first one at t + ttl or later: times and questions in one descending order, read once.
    asked = times.select("key", "t", F.col("t").alias("x"), F.lit(1).alias("real")).unionByName(times.select("key", "t", (F.col("t") + ttl).alias("x"), F.lit(0).alias("real")))
    before_it = Window.partitionBy("key").orderBy(F.desc("x"), F.desc("real")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.last(F.when(F.col("real") == 1, F.col("t")), ignorenulls=True).over(before_it)
    jumps, missed = Steps(requests.sparkSession, "jumps"), Steps(requests.sparkSession, "misses")
    jump = jumps.put(asked.withColumn("to", later).where("real = 0 and to is not null").select("key", "t", "to"))
    misses = missed.put(times.groupBy("key").agg(F.min("t").alias("t")))
    before = -1
    while (now := misses.count()) != before:
        before = now
        reached = misses.join(jump, ["key", "t"]).select("key", F.col("to").alias("t"))
        misses = missed.put(misses.union(reached).distinct())
        jump = jumps.put(jump.alias("x").join(jump.select("key", F.col("t").alias("m"), F.col("to").alias("z")).alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.to") == F.col("y.m"))).select("x.key", "x.t", F.col("y.z").alias("to")))
    marked = requests.join(misses.withColumn("_miss", F.lit(True)), ["key", "t"], "left")
    # Only the requests of a miss's own second are numbered; a second with many of them is the largest group.
    order = Window.partitionBy("key", "t").orderBy(*[c for c in requests.columns if c not in ("key", "t")] or ["key"])
    filled = marked.where("_miss").withColumn("hit", F.row_number().over(order) > 1)
    return filled.unionByName(marked.where("_miss is null").withColumn("hit", keyed)).drop("_miss")


class _Cache(StatefulProcessor):
    """One key's cache: the time that filled it, and the requests that wait for the watermark, so that they are taken by time."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filled = handle.getValueState("filled", "t long")
        self.waiting = handle.getListState("waiting", "t long, id long")

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            self.waiting.appendList([(int(t), int(i)) for t, i in zip(frame["t"], frame["id"], strict=True)])
            first = int(frame["t"].min()) if first is None else min(first, int(frame["t"].min()))
        if first is not None:
            due = [timer // 1000 for timer in self.handle.listTimers()]
            self._wake(min([first + 1, *due]))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "t": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "hit": pd.Series([], dtype=bool)})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        waiting = sorted((int(t), int(i)) for t, i in self.waiting.get())
        ready, later = [x for x in waiting if x[0] < now], [x for x in waiting if x[0] >= now]
        filled = int(self.filled.get()[0]) if self.filled.exists() else None
        hits = []
        for t, _ in ready:
            hit = filled is not None and t < filled + self.ttl
            filled = filled if hit else t
            hits.append(hit)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        if filled is not None and filled + self.ttl > now:
            self.filled.update((filled,))
            self._wake(min([filled + self.ttl, *(t + 1 for t, _ in later)]))
        else:
            self.filled.clear()  # expired: a key that isn't asked for holds no state
            if later:
                self._wake(later[0][0] + 1)
        yield pd.DataFrame({"key": [key[0]] * len(ready), "t": [t for t, _ in ready], "id": [i for _, i in ready], "hit": hits})


def cache_hits_stream(requests: DataFrame, ttl: int = TTL_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """S4 as a stream: requests (key, ts, id) give (key, t, id, hit), each once the watermark has passed its second.

    A key's state is the time that filled the cache and the requests not yet passed by the watermark; a timer drops it when
    the cache has expired. Requests without key or time pass as misses without state. Requests of one second are taken by
    id, as in the batch twin. Needs a state store that has timers: spark.sql.streaming.stateStore.providerClass must be
    the RocksDB one.
    """
    rows = requests.withWatermark("ts", watermark).withColumn("t", F.unix_seconds("ts"))
    held = F.col("key").isNotNull() & F.col("ts").isNotNull()
    schema = "key string, t long, id long, hit boolean"
    kept = rows.where(held).groupBy("key").transformWithStateInPandas(_Cache(ttl), schema, "Append", "EventTime")
    return kept.unionByName(rows.where(~held).select("key", "t", F.col("id").cast("long").alias("id"), F.lit(False).alias("hit")))


class FusionState:
    """Identity groups kept up to date batch by batch, as labels and keys in buckets of runs below path.

    A batch joins the keys it shares with earlier ones; only components that it touches are labelled anew, with the
    smallest seq of all that they now hold, so the state after any order of batches is that of one batch. A batch reads and
    writes the buckets of its runs; labels and keys become visible at once, a batch that failed leaves the version before,
    and one that is run again is done once. A new object on a path goes on from the state there. Versions ascend.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        schemas = {"labels": "run_id string, seq long, component long", "keys": "run_id string, key string, component long"}
        self.store = Buckets(spark, path, schemas, ["run_id"], buckets, bucket_rows)

    def labels(self) -> DataFrame:
        return self.store.read("labels")

    def update(self, hits: DataFrame, version: int) -> None:
        keys = saved(identity_keys(hits).select("run_id", "key", F.col("seq").cast("long").alias("seq")), "batch-keys")
        buckets = self.store.touched(keys)
        labels, known = self.store.read("labels", buckets), self.store.read("keys", buckets)
        touched = known.join(keys.select("run_id", "key").distinct(), ["run_id", "key"], "left_semi").select("run_id", "key", F.col("component").alias("seq"))
        all_ = saved(keys.unionByName(touched), "touched-keys")
        first = all_.groupBy("run_id", "key").agg(F.min("seq").alias("first"))
        found = components(all_.join(first, ["run_id", "key"]).select("run_id", F.col("seq").alias("a"), F.col("first").alias("b")), ["run_id"], "intake").select("run_id", F.col("id").alias("component"), "root")
        # Old and new rows alike: a component that the batch joined to a smaller one takes its label.
        under = lambda df: df.join(found, ["run_id", "component"], "left").withColumn("component", F.coalesce("root", "component")).drop("root")
        new_labels = under(labels.unionByName(keys.select("run_id", "seq", F.col("seq").alias("component")).distinct())).groupBy("run_id", "seq").agg(F.min("component").alias("component"))
        new_keys = under(known.unionByName(keys.select("run_id", "key", F.col("seq").alias("component")))).groupBy("run_id", "key").agg(F.min("component").alias("component"))
        self.store.commit(version, {"labels": new_labels, "keys": new_keys}, buckets)


def fuse_stream(hits: DataFrame, state: FusionState, checkpoint: str):
    """S5 as a stream: every micro-batch updates the state."""
    return hits.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, i: state.update(df, i)).start()
