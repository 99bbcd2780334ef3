"""Line dedup against SQL and a loop, with levels that fill and merge, and odd rows."""

import pathlib

import duckdb
import pytest

from folium.llm import lines, queries
from tests.llm.test_pipeline import key


def test_table(spark, sf):
    got = {tuple(r[c] for c in ("doc_id", "n_lines", "n_dropped", "kept_sha256")) for r in queries.op2_line_dedup(spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == set(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({queries.OP2_SQL})").fetchall())


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (9, 3)])
def test_batches(spark, batches, fanout):
    rows = [(i, "\n".join([f"common line number {i % 3}", "short", f"  Own line of {i // 2}\t", f"OWN line of {i // 2}", ""])) for i in range(40)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches, fanout).collect()
    first = {}
    for doc_id, text in rows:
        for line in text.split("\n"):
            first.setdefault(key(line), doc_id)
    for r in out:
        want = [line for line in rows[r["doc_id"]][1].split("\n") if len(key(line)) < 10 or first[key(line)] == r["doc_id"]]
        assert r["text"] == "\n".join(want) and r["n_lines"] == 5 and r["n_dropped"] == 5 - len(want)


def test_odd_rows(spark):
    long = "\n".join(f"a line that is long enough {i}" for i in range(700))
    rows = [(1, None, 7), (2, "", 7), (3, long, 7), (4, long + "\nthe only new line", 7), (4, "the only new line", 7), (None, "the only new line", 7), (5, "ÀÉ the Line ß", 7), (6, " àé the line ß", 7), (7, " ÀÉ the LINE ß\r", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int").selectExpr("*", "1 as h1", "2 as _n", "3 as n_lines")
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_dropped"]
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"], r["pos"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "", 1, 0, 7), (2, "", 1, 0, 7), (3, long, 700, 0, 7), (4, "the only new line", 701, 700, 7), (4, "the only new line", 1, 0, 7), (0, "the only new line", 1, 0, 7), (5, "ÀÉ the Line ß", 1, 0, 7), (6, " àé the line ß", 1, 0, 7), (7, "", 1, 1, 7)], key=repr)
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_runs_are_read_in_order_and_dropped(spark):
    """No shuffle or sort above a run in the merge-anti-join; a failed batch leaves no table and no setting behind."""
    tables, option = spark.catalog.listTables(), spark.conf.get(lines._ORDERED, None)
    hashed = lines.hashed_lines(spark.createDataFrame([(i, f"a line of document {i}\na line of all of them") for i in range(50)], "doc_id long, text string"))
    with pytest.raises(RuntimeError), lines.LineRuns(spark) as runs:
        assert runs.add(hashed.where("doc_id < 20")).count() == 19
        runs.compact()
        assert runs.add(hashed.where("doc_id >= 20 and doc_id < 40")).count() == 20
        left = runs.holders(hashed)
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2
        assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1, plan
        assert left.count() == 10
        runs.compact()
        assert len(runs.runs()) == 1 and runs.holders(hashed).count() == 10
        raise RuntimeError
    assert spark.catalog.listTables() == tables and spark.conf.get(lines._ORDERED, None) == option


def test_runs_are_below_the_checkpoint_folder_and_go(spark):
    """Buckets follow the lines, runs lie in the shared folder, and files go with their tables."""
    hashed = lines.hashed_lines(spark.createDataFrame([(i, f"a line of document {i}") for i in range(90)], "doc_id long, text string"))
    assert lines.LineRuns(spark).buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
    with lines.LineRuns(spark, rows=90, bucket_rows=10) as runs:
        assert runs.buckets == 9
        for a in (0, 30, 60):
            runs.add(hashed.where(f"doc_id >= {a} and doc_id < {a + 30}"))
            runs.compact()
        folders = list(runs.folders.values())
        assert len(folders) == 2 and sum(r.count() for r in runs.runs()) == 90
        assert all(f.startswith(spark.conf.get("spark.checkpoint.dir")) and len(list(pathlib.Path(f).glob("part-*"))) <= 9 for f in folders)
    assert not any(pathlib.Path(f).exists() for f in folders)
