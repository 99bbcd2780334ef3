"""Queries whose runs hold all documents: records a thousand ids apart still meet."""

import hashlib

import pytest

from folium.operators import filters, graph, ranking
from folium.plans import registry

QUERIES = registry.queries()
TEXT = "same title\nsame body"  # 20 characters: run r0


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Documents 12 and 2012 of one text, a third one apart, and one page request of run r0."""
    at = str(tmp_path_factory.mktemp("far"))
    rows = [(12, TEXT, "en", "src1", 20), (2012, TEXT, "en", "src1", 20), (7, "other", "de", "src1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(12, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(50, 10)], "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    return at


def rows(spark, far, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, far).select(*columns).collect())


def test_a_request_reads_its_whole_run(spark, far):
    assert rows(spark, far, "p4_filter_results", "request_id", "seq") == [(50, 12), (50, 2012)]


def test_equal_records_are_one_group(spark, far):
    assert rows(spark, far, "f2_identity_groups", "seq", "component") == [(7, 7), (12, 12), (2012, 12)]


def test_fields_are_fused_over_a_whole_run(spark, far):
    abstract = hashlib.sha256(TEXT.encode()).hexdigest()
    assert rows(spark, far, "f4_fuse_fields", "component", "n_records", "year", "paper_type", "abstract")[1:] == [(12, 2, 2002, "article", abstract)]


def test_authors_are_merged_over_a_whole_run(spark, far):
    merged = [(1, "Author 20", "0000-5", "Inst 2", "arxiv=arxiv-1"), (2, "AUTHOR  12", None, None, ""), (3, "Author 20", "0000-3", None, "arxiv=arxiv-10")]
    got = QUERIES["f6_merge_authors"](spark, far).where("component = 12").select("position", "name", "orcid", "institution", "ids").collect()
    assert sorted(map(tuple, got)) == merged


def test_a_work_family_spans_a_whole_run(spark, far):
    doi = "doi:10.5555/" + hashlib.md5(TEXT.encode()).hexdigest()[:12]
    family = "work-" + hashlib.sha256(f"arxiv:2401.00020|{doi}".encode()).hexdigest()[:16]
    got = QUERIES["f8_work_family"](spark, far).where("run_id like 'r0%'").select("component", "work_family_id").collect()
    assert sorted(map(tuple, got)) == [(12, family)]


def test_a_page_is_of_its_whole_run(spark, far):
    assert rows(spark, far, "r7_page_results", "at", "paper_id", "total", "shown_page") == [(1, "doc:2012", 2, 1), (2, "doc:12", 2, 1)]


def test_rows_of_a_request_lie_together(spark):
    papers = spark.range(400).selectExpr("'r' as run_id", "concat('p', id) as paper_id", "'s' as source", "'satisfied' as status", "2000 as year")
    requests = spark.range(5).selectExpr("id as request_id", "'r' as run_id", "cast(null as string) as source", "cast(null as string) as status", "1990 as year_from", "cast(null as int) as year_to")
    at = [r[0] for r in filters.filter_results(papers.hint("merge"), requests.hint("merge")).select("request_id").collect()]
    assert len(at) == 2000 and sum(a != b for a, b in zip(at, at[1:])) < 5 * filters.PARTS


def test_a_request_without_page_shows_the_last(spark):
    papers = [("r", f"p{i:02}", 2000, i, "satisfied", 0.5, 0.5, 0.5, 0.5) for i in range(12)]
    results = spark.createDataFrame(papers, "run_id string, paper_id string, year int, citation_count int, status string, relevance double, pair_score double, semantic_score double, rrf_score double")
    requests = spark.createDataFrame([(1, "r", "citation_desc", None, 5), (2, "r", "citation_desc", 1, 5)], "request_id long, run_id string, sort string, page int, page_size int")
    got = ranking.page_results(results, requests, "run_id").select("request_id", "at", "paper_id").collect()
    assert sorted(map(tuple, got)) == [(1, 11, "p01"), (1, 12, "p00"), *((2, i, f"p{12 - i:02}") for i in range(1, 6))]


def test_chains_go_through_whole_runs(spark, far):
    assert rows(spark, far, "g3_same_work_edges", "src", "dst") == [(2012, 12)]


def test_chains_cross_empty_stretches(spark):
    places = [(1, 5), (2, 9_999), (3, 10_000), (4, 45_000), (5, 45_001)]
    nodes = spark.createDataFrame([("r", i, p, "f") for i, p in places] + [("r", 9, 7, ""), ("s", 1, 30_000, "f")], "run_id string, id long, position long, family string")
    assert sorted(map(tuple, graph.same_work_edges(nodes).select("src", "dst").collect())) == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_every_request_is_of_one_run(spark, far, tmp_path):
    """Order 100 of customer 13 asks for the run r0, as order 50 of customer 10 does."""
    for name in ("documents", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{far}/{name}.parquet")
    spark.createDataFrame([(50, 10), (100, 13)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(spark, str(tmp_path), "p4_filter_results", "request_id", "seq") == [(50, 12), (50, 2012), (100, 12)]
