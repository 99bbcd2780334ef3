"""Tables in buckets: upserts, versions that appear at once, and reads that don't grow with what is there."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folium.operators.fusion import identity_groups
from folium.plans.fixtures import view
from folium.sources.buckets import Buckets, upsert
from folium.streaming.streams import FusionState

SCHEMA = "k long, at long, v string"


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = Buckets(spark, str(tmp_path / "t"), {"t": SCHEMA}, ["k"], 8)
    put = lambda version, rows: upsert(store, version, "t", spark.createDataFrame(rows, SCHEMA), ["k"], ["at"])
    rows = lambda: {tuple(r) for r in store.read("t").collect()}
    put(0, [(i, 1, "a") for i in range(100)])
    before, named = files(store.path), set(store.manifest())
    put(1, [(7, 2, "b"), (7, 0, "old"), (500, 1, "new"), (None, 1, "null")])
    assert rows() == {(i, 1, "a") for i in range(100) if i != 7} | {(7, 2, "b"), (500, 1, "new"), (None, 1, "null")}
    after = files(store.path)
    assert before.items() <= after.items() and len(named & set(store.manifest())) >= 5  # buckets without a change keep their files
    put(1, [(7, 9, "again")])  # the same version again changes nothing
    assert (7, 2, "b") in rows()
    with pytest.raises(ValueError):
        put(0, [(7, 9, "late")])
    store.vacuum()
    assert len(rows()) == 102 and len(files(store.path)) == len(store.manifest()) < len(after)


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    sf_rows = [("r", i, "A" if i < 3 else f"T{i}") for i in range(6)]
    hits = spark.createDataFrame(sf_rows, "run_id string, seq long, title string").withColumns({c: F.lit(None).cast("string") for c in ("doi", "arxiv_id", "pmid", "first_author")} | {"source": F.lit("s"), "paper_id": F.col("title"), "year": F.lit(2000)})
    state = FusionState(spark, str(tmp_path / "s"))
    state.update(hits.where("seq > 1"), 0)
    before = sorted(map(tuple, state.labels().collect()))
    real, calls = Buckets._write, []

    def write(self, folder, tables, n):
        calls.append(folder)
        real(self, folder, {"labels": tables["labels"]}, n)
        raise OSError("lost between the two tables")

    monkeypatch.setattr(Buckets, "_write", write)
    with pytest.raises(OSError):
        state.update(hits.where("seq < 2"), 1)
    assert sorted(map(tuple, state.labels().collect())) == before and state.store.read("keys").where("component = 0").count() == 0
    monkeypatch.undo()
    FusionState(spark, str(tmp_path / "s")).update(hits.where("seq < 2"), 1)
    assert sorted(map(tuple, state.labels().collect())) == sorted(map(tuple, identity_groups(hits).collect())) and calls


def test_reads_do_not_grow_with_history(spark, sf, tmp_path, monkeypatch):
    """Each batch brings two new runs; what it reads of the state stays below the bound of its buckets."""
    hits = view(spark, sf, "fx_hits").orderBy("seq").limit(40)
    hits = spark.createDataFrame(hits.collect(), hits.schema)
    state = FusionState(spark, str(tmp_path / "s"), buckets=2, bucket_rows=150)
    read, real = [], Buckets.read

    def counted(self, name, buckets=None):
        df = real(self, name, buckets)
        read.append(df.count())
        return df

    for i in range(7):
        monkeypatch.setattr(Buckets, "read", counted)
        part = hits.withColumn("run_id", F.lit(f"a{i}")).unionByName(hits.withColumn("run_id", F.lit(f"b{i}")))
        read.append(0)
        state.update(part, i)
        monkeypatch.undo()
    total = state.labels().count() + state.store.read("keys").count()
    assert state.labels().count() == 14 * 40 and state.store.number() > 2
    assert sum(read[-2:]) < total / 2
