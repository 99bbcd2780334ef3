"""Rows on which Spark and the SQL in DuckDB once came apart: letters without a capital, blank texts, scores that nearly tie."""

import duckdb
import pytest

from folium.plans import registry
from folium.plans.fixtures import doubles
from tests.test_oracles import plain

QUERIES, SQL = registry.queries(), registry.oracle_sql()
TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", [
        (7, "One title of some length\nand a body", "en", "src1", 35), (57, "Another title of a length\nand a body", "en", "src1", 35),
        (8, "In der Straße und im Weg", "de", "src2", 24), (9, "", "en", "src2", 0), (10, "  ", "en", "src2", 2), (11, "\nbody only", "en", "src2", 10), (12, "IN DER STRA\u1e9eE UND IM WEG", "de", "src2", 24),
    ]),
    "labels": ("doc_id long, quality int, toxic int", [(7, 1, 0), (57, 0, 0)]),
    "benchmark": ("item_id long, text string", [(0, "der Straße und")]),
    "embeddings": ("vec_id long, embedding array<float>, label int", [(i, [1.0, float(i)], 0) for i in (*range(13), 57, 60)]),
}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at, con = str(tmp_path_factory.mktemp("odd")), duckdb.connect()
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
    return at, con


def agree(spark, odd, name):
    at, con = odd
    rows, want = QUERIES[name](spark, at).collect(), con.sql(SQL[name])
    columns = want.columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    return [dict(zip(columns, r, strict=True)) for r in got]


def test_capitals_of_a_letter_without_one_are_evidence(spark, odd):
    found = {r["paper_id"]: r["n"] for r in agree(spark, odd, "p6_validate_evidence")}
    assert (found[8], found[12], found[7]) == (2, 2, 0)


def test_a_blank_abstract_leaves_its_label(spark, odd):
    assert {r["pmid"] for r in agree(spark, odd, "i5_pubmed")} == {"7", "8", "9", "10", "11", "12", "57"}


def test_a_blank_title_is_none(spark, odd):
    assert {r["dblp_key"]: r["title"] for r in agree(spark, odd, "i4_dblp")}["k/9"] is None


def test_scores_are_doubles_where_papers_are_ranked(spark, odd):
    assert [r["paper_id"] for r in sorted(agree(spark, odd, "r4_rank_assessed"), key=lambda r: r["rank"]) if r["run_id"] == "r5-0"] == ["doc:7", "doc:57"]


def test_scores_are_doubles_in_the_cascade(spark, odd):
    assert [r["paper_id"] for r in sorted(agree(spark, odd, "r6_cascade"), key=lambda r: r["rank"]) if r["run_id"] == "r5-0"] == ["doc:7", "doc:57"]


def test_numbers_in_strings_stay():
    assert doubles("SELECT '10.5555/', x / 100.0, 'it''s 2.5' FROM t") == "SELECT '10.5555/', x / 100.0D, 'it''s 2.5' FROM t"
