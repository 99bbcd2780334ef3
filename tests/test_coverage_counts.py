"""C2, C3 and C6 on rows worked by hand: texts are read once, counts are summed over rounds."""

from folium.operators import rounds as c

INTENTS = "run_id string, must array<string>, datasets array<string>, methods array<string>, year_start int, year_end int, target_count int"
HITS = "run_id string, round int, seq long, identity string, source string, title string, abstract string, venue string, paper_type string, year int, status string, relevance double"


def intents(spark, *rows):
    return spark.createDataFrame(list(rows), INTENTS)


def hits(spark, *rows):
    return spark.createDataFrame([(*r[:4], "openalex", r[4], r[5], None, None, *r[6:]) for r in rows], HITS)


def flagged(spark, rows, asked):
    return c.relevance_flags(rows, asked)


def test_matches_are_read_once(spark):
    asked = intents(spark, ("a", ["Graph ", "graph ", " ", None, "STRASSE"], None, ["graph "], 2000, 2010, 2), ("b", None, None, None, None, None, 1))
    rows = hits(spark, ("a", 1, 1, "x", "A GRAPH", "on a Straße", 2005, "satisfied", 0.9), ("a", 1, 2, "y", "graph", None, None, "uncertain", 0.9), ("b", 1, 3, "z", None, None, 2005, "satisfied", None))
    read = c.read_matches(flagged(spark, rows, asked), asked)
    got = {r.seq: (sorted((x.gap_type, x.constraint) for x in r.held or []), r.in_years) for r in read.collect()}
    assert got == {1: ([("method", "graph "), ("must_include", "Graph "), ("must_include", "STRASSE"), ("must_include", "graph ")], True), 2: ([], False), 3: ([], False)}
    n = {r.constraint: r.n for r in c.match_counts(flagged(spark, rows, asked), asked, "must").collect()}
    assert n == {"Graph ": 1, "graph ": 1, "STRASSE": 1, " ": 0, None: 0}


def test_a_round_sees_the_last_version_of_what_came_before(spark):
    asked = intents(spark, ("a", ["graph"], None, None, 2000, 2010, 2), ("none", ["graph"], None, None, 2000, 2010, 2))
    rows = hits(
        spark,
        ("a", 1, 1, "x", "tree", None, 2005, "satisfied", 0.9),
        ("a", 2, 2, "x", "graph", None, 1990, "satisfied", 0.9),  # the later version stands for the paper from its first round on
        ("a", 2, 3, "y", "tree", None, 2005, "satisfied", 0.9),
        ("a", 3, 4, "z", "tree", None, None, "uncertain", 0.9),
    )
    got = {(r.run_id, r.round): (r.n_high, r.n_partial, r.n_gaps, r.n_new, r.stop_reason, r.executed) for r in c.replay_rounds(rows, asked).collect()}
    assert got[("a", 1)] == (1, 0, 2, 1, None, True)  # no paper in the years, too few results
    assert got[("a", 2)] == (2, 0, 0, 1, "target_met", True)
    assert got[("a", 3)] == (2, 1, 0, 0, "target_met", False)
    assert [got[("none", n)][:3] for n in (1, 2, 3)] == [(0, 0, 0)] * 3


def test_gaps_of_a_run_without_papers(spark):
    asked = intents(spark, ("a", ["graph"], ["set"], None, 2000, 2010, 2))
    rows = hits(spark, ("b", 1, 1, "x", "graph", None, 2005, "satisfied", 0.9))
    sources = spark.createDataFrame([], "run_id string, source string, n long, unavailable boolean")
    gaps = c.coverage_gaps(flagged(spark, rows, asked), asked, sources)
    assert [(r.gap_type, r.constraint, r.severity, r.position) for r in gaps.orderBy("position").collect()] == [("must_include", "graph", 1.0, 1), ("dataset", "set", 0.9, 2)]
