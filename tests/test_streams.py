"""Each stream, run over files by availableNow, against its batch twin."""

from pyspark.sql import functions as F

from folium.plans import streams as ps
from folium.plans.fixtures import view
from folium.plans.fusion import f
from folium.sources.store import latest
from folium.streaming import streams as st

SCHEMA = "run_id long, ts timestamp, seq long, event_type string, value double"


def staged(spark, sf, folder, parts=3):
    """The events as files, in the order of time."""
    events = ps.events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.orderBy("ts", "seq").collect()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, SCHEMA), spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_latest_progress(spark, sf, tmp_path):
    events, stream = staged(spark, sf, f"{tmp_path}/in")
    st.keep_latest(st.latest_progress(stream), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = latest(spark.read.parquet(f"{tmp_path}/out"), ["run_id"], ["batch"])
    columns = ("run_id", "event_type", "value", "n", "terminal")
    assert as_set(got, *columns) == as_set(st.latest_progress(events), *columns)


def test_bounded_feed(spark, sf, tmp_path):
    events, stream = staged(spark, sf, f"{tmp_path}/in")
    query = st.bounded_feed_stream(stream, 3).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).start()
    query.awaitTermination()
    got = latest(spark.read.parquet(f"{tmp_path}/out"), ["run_id", "age"], ["batch"])
    assert as_set(got, "run_id", "age", "seq") == as_set(st.bounded_feed(events, 3), "run_id", "age", "seq")


def test_stalled_runs(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [(1, at(0), 1, "view"), (2, at(0), 2, "view"), (2, at(30), 3, "completed"), (3, at(600), 4, "view"), (3, at(1500), 5, "view"), (9, at(1600), 6, "view")]
    events = spark.createDataFrame(rows, "run_id long, at string, seq long, event_type string").select("run_id", F.to_timestamp("at").alias("ts"), "seq", "event_type", F.lit(0.0).alias("value"))
    for lo, hi in ((0, 40), (40, 1000), (1000, 1550), (1550, 9999)):
        events.where(f"unix_seconds(ts) - unix_seconds(timestamp'2024-01-01') >= {lo} and unix_seconds(ts) - unix_seconds(timestamp'2024-01-01') < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = st.stalled_runs_stream(stream, 700).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).start()
    query.awaitTermination()
    got = as_set(spark.read.parquet(f"{tmp_path}/out"), "run_id")
    assert (1,) in got and (2,) not in got and (9,) not in got
    assert as_set(st.stalled_runs(events, 700), "run_id") == {(1,)}


def test_incremental_groups(spark, sf, tmp_path):
    hits = view(spark, sf, "fx_hits")
    for part in (1, 2, 0):
        hits.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state = st.FusionState(spark, f"{tmp_path}/state")
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    st.fuse_stream(stream, state, f"{tmp_path}/c").awaitTermination()
    assert as_set(state.labels(), "run_id", "seq", "component") == as_set(f.identity_groups(hits), "run_id", "seq", "component")


def test_intake_goes_on_after_a_restart(spark, sf, tmp_path):
    hits = view(spark, sf, "fx_hits")
    for i in range(2):
        st.FusionState(spark, f"{tmp_path}/state").update(hits.where(F.col("seq") % 2 == i), i)
    state = st.FusionState(spark, f"{tmp_path}/state")
    assert as_set(state.labels(), "run_id", "seq", "component") == as_set(f.identity_groups(hits), "run_id", "seq", "component")


def test_cache_of_one_hot_key(spark):
    rows = spark.range(60_000).selectExpr("'k' AS key", "id * 7 AS t", "id")
    hits = st.cache_hits(rows, 100).where("not hit")
    assert [r["t"] for r in hits.orderBy("t").limit(4).collect()] == [0, 105, 210, 315] and hits.count() == 4000


def test_cache_keys_tell_requests_apart(spark):
    rows = [("2000", None), (None, "2000"), ("2000 ", None), ("2000", ""), ("a", "B"), ("a", "b"), ("a|b", None), ("a", "b\x1f")]
    df = spark.createDataFrame(rows, "year string, q string")
    key = lambda *names, **more: st.cache_key(F.lit("arxiv"), F.lit("search"), {n: F.col(n) for n in names}, **more)
    assert df.select(key("year", "q").alias("k")).distinct().count() == len(rows)
    one = df.limit(1).select(key("year", "q").alias("a"), key("q", "year").alias("b"), key("year", "q", version="v2").alias("c"), key("year").alias("d"), st.cache_key("q", F.lit("x"), {}).alias("e")).first()
    assert one["a"] == one["b"] and len({one["a"], one["c"], one["d"]}) == 3 and one["e"] is None
    assert one["a"].startswith("arxiv:search:v1:") and len(one["a"]) == len("arxiv:search:v1:") + 64


def test_requests_without_key_or_time_never_hit(spark):
    rows = [(None, 1, 1), (None, 2, 2), ("k", None, 3), ("k", None, 4), ("k", 5, 5), ("k", 5, 6), ("k", 6, 7), ("k", 105, 8), ("k", 106, 9)]
    got = {r["id"]: r["hit"] for r in st.cache_hits(spark.createDataFrame(rows, "key string, t long, id long"), 100).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False, 9: True}


def test_cache_stream_and_restart(spark, tmp_path):
    """Requests in some disorder, in files; the stream is stopped after each run and goes on from its checkpoint."""
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = sorted(((rng.choice([*"abc", None]), 1000 + rng.randrange(900), i) for i in range(240)), key=lambda r: r[1] + rng.randrange(20))
    rows.append(("end", 5000, 999))  # passes the watermark over all others
    path, schema = f"{tmp_path}/in", "key string, ts timestamp, id long"
    frame = lambda part: spark.createDataFrame(part, "key string, t long, id long").select("key", F.timestamp_seconds("t").alias("ts"), "id")
    for n, part in enumerate((rows[:80], rows[80:170], rows[170:])):
        for half in (part[: len(part) // 2], part[len(part) // 2 :]):
            frame(half).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = st.cache_hits_stream(stream, 60, "30 seconds")
        out.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "t", "id", "hit").where("id < 999").collect()]
    want = st.cache_hits(spark.createDataFrame(rows, "key string, t long, id long"), 60).where("id < 999").select("key", "t", "id", "hit")
    want = {tuple(r) for r in want.collect()}
    assert set(got) ^ want == set() and len(got) == 240
