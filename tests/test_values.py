"""Values worked out by hand."""

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from folium.functions import norm
from folium.operators import filters, fusion, graph, library, lookup, ranking, reports, rounds, vectors
from folium.operators.components import components, greedy_keep
from folium.sources.payloads import ingest_dblp, ingest_openalex, repair, split_bad

HITS = "run_id string, seq long, paper_id string, source string, title string, first_author string, year int, venue string, doi string, arxiv_id string, pmid string, abstract string, paper_type string, citation_count int, raw_rank int, round int"


def hit(seq, source="openalex", title="T", author="A", year=2020, doi=None, arxiv=None, pmid=None, kind="article", rank=1, abstract="", venue=None, run="r"):
    return (run, seq, f"{source}-{seq}", source, title, author, year, venue, doi, arxiv, pmid, abstract, kind, 0, rank, 1)


def groups(spark, rows):
    return fusion.grouped(spark.createDataFrame(rows, HITS))


def component(df):
    return {r["seq"]: r["component"] for r in df.collect()}


def test_rrf(spark):
    prov = spark.createDataFrame([("r", 1, "a", 2), ("r", 1, "b", 4), ("r", 2, "a", 1), ("r", 2, "b", 3), ("r", 3, "a", None)], "run_id string, component long, source string, best_rank int")
    got = {r["component"]: r["rrf_score"] for r in fusion.rrf(prov).collect()}
    assert got[1] == pytest.approx(1 / 62 + 1 / 64) and 3 not in got
    weighted = {r["component"]: r["rrf_score"] for r in fusion.rrf(prov, {"a": 2.0, "b": 0.5}, 10).collect()}
    assert weighted[2] == pytest.approx(2 / 11 + 0.5 / 13)


def test_identity(spark):
    rows = [hit(1, doi="https://doi.org/10.48550/arXiv.1805.12152"), hit(2, "arxiv", arxiv="1805.12152v1", title="x"), hit(3, "dblp", title="Ｓame  Title"), hit(4, "pubmed", title="same title"), hit(5, "s2", title="Same Title", doi="10.1/x"), hit(6, title="Same Title", year=None), hit(7, doi="10.1/X.", run="q")]
    assert component(groups(spark, rows)) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_fields_and_versions(spark):
    rows = [hit(1, doi="10.1/a", abstract="short", kind="preprint", year=None), hit(2, "dblp", doi="10.1/a", abstract="much longer", venue="V", year=2019)]
    r = fusion.fuse_fields(groups(spark, rows)).collect()[0]
    assert (r["abstract"], r["venue"], r["year"], r["paper_type"], r["paper_id"], r["n_records"]) == ("much longer", "V", 2019, "article", "dblp-2", 2)
    fused = spark.createDataFrame([("r", 1, "One", "A", 2024, "preprint", "w1"), ("r", 2, "one", "a", 2025, "conference", "w2"), ("r", 3, "Two", "A", 2020, "preprint", "w3"), ("r", 4, "Two", "A", 2023, "article", "w4")], "run_id string, component long, title string, first_author string, year int, paper_type string, work_family_id string")
    family = {x["component"]: x["version_family_id"] for x in fusion.link_versions(fused).collect()}
    assert family[1] == family[2] not in ("w1", "w2") and (family[3], family[4]) == ("w3", "w4")


def test_first_kept_is_not_two_rounds_of_distinct(spark):
    rows = [("r", i, s, "s", t, "A", 2020, None, None, None) for i, s, t in ((1, "s1", "t1"), (2, "s2", "t1"), (3, "s2", "t2"))]
    df = spark.createDataFrame(rows, "run_id string, seq long, paper_id string, source string, title string, first_author string, year int, doi string, arxiv_id string, pmid string")
    assert sorted(r["seq"] for r in fusion.dedup_first(df, ["run_id"]).collect()) == [1, 3]


def test_greedy_chain(spark):
    ids = spark.createDataFrame([(1, i) for i in range(12)], "run_id int, id long")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(11)], "run_id int, a long, b long")
    assert {r["id"] for r in greedy_keep(ids, edges, ["run_id"]).where("kept").collect()} == {0, 2, 4, 6, 8, 10}


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(k, i, i + 1) for k in (1, 2) for i in range(60)] + [(3, 5, 5)], "run_id int, a long, b long")
    got = components(edges, ["run_id"]).collect()
    assert len(got) == 122 and {r["root"] for r in got} == {0}


def test_filter_reasons(spark):
    intents = spark.createDataFrame([("r", 2015, 2022, ["NeurIPS"], ["Ada"], ["MIT"], ["Graph"], ["survey"])], "run_id string, year_start int, year_end int, venues array<string>, authors array<string>, institutions array<string>, must array<string>, exclude array<string>")
    base = dict(run_id="r", title="A graph method", abstract="", year=2020, venue="neurips 2020", authors=["Ada L"], institutions=["MIT"])
    rows = [base, base | {"venue": None}, base | {"year": None}, base | {"year": 2023}, base | {"venue": "ICML"}, base | {"authors": ["Bob"]}, base | {"institutions": ["ETH"]}, base | {"title": "tree"}, base | {"abstract": "A SURVEY"}, base | {"authors": []}]
    df = spark.createDataFrame([tuple(r[k] for k in base) + (i,) for i, r in enumerate(rows)], "run_id string, title string, abstract string, year int, venue string, authors array<string>, institutions array<string>, i int")
    got = {r["i"]: r["fail_reason"] for r in filters.filter_reason(df, intents).collect()}
    assert [got[i] for i in range(10)] == [None, None, "year_range", "year_range", "venue", "author", "institution", "must_include", "exclude", None]


def test_costs(spark):
    rows = [("deepseek-v4-pro", 1_000_000, 1_000_000, 0, "2026-01-01 02:00:00"), ("deepseek-v4-pro", 1_000_000, 1_000_000, 0, "2026-01-01 05:00:00"), ("deepseek-chat", 1_000_000, 0, 1_000_000, "2026-01-01 05:00:00"), ("other", 5, 5, 5, "2026-01-01 02:00:00"), ("deepseek-v4-flash", -5, -5, 3, "2026-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "model string, prompt_tokens long, completion_tokens long, cache_hit_tokens long, at string").withColumns({"occurred_at_utc": F.to_timestamp("at"), "cache_miss_tokens": F.lit(None).cast("long")})
    assert [(r["cost"], r["peak"]) for r in reports.call_cost(df).collect()] == [(18.0, True), (9.0, False), (0.02, False), (0.0, False), (0.0, True)]


def test_assessed(spark):
    papers = spark.createDataFrame([("r", f"p{i}", f"title {i}", "", 2020, None, "article", None, None, 1.0 / i, i) for i in range(1, 25)], "run_id string, paper_id string, title string, abstract string, year int, venue string, paper_type string, pair_score double, semantic_score double, rrf_score double, position int")
    rows = [("r", "p1", 1, 1, 0.9, "satisfied", ["title 1"], "good"), ("r", "p2", 1, 2, 0.95, "satisfied", ["invented"], "bad"), ("r", "p3", 1, 3, 0.5, "satisfied", ["title 3"], "so"), ("r", "p4", 1, 4, 0.2, "satisfied", ["title 4"], "no"), ("r", "p5", 1, 5, 0.8, "not_satisfied", ["title 5"], "no")]
    assessed = spark.createDataFrame(rows, "run_id string, paper_id string, batch int, item int, relevance double, status string, evidence array<string>, reason string")
    kept, counts = ranking.rank_assessed(papers, assessed, spark.createDataFrame([("r", 3)], "run_id string, target_count int"))
    assert [(r["paper_id"], r["final_status"], r["recommendation"]) for r in kept.orderBy("rank").collect()] == [("p2", "uncertain", None), ("p1", "satisfied", "good"), ("p3", "uncertain", "so")]
    assert tuple(counts.collect()[0]) == ("r", 2, 19)


def test_normal_forms(spark):
    rows = spark.createDataFrame([("  ＡＢ Straße\tΣΊΣΥΦΟΣ ŉ ",)], "t string")
    r = rows.select(norm.norm_strong("t").alias("s"), norm.norm_weak("t").alias("w"), norm.norm_token("t").alias("k"), norm.query_language(F.lit("深度 learning")).alias("l")).collect()[0]
    text = "  ＡＢ Straße\tΣΊΣΥΦΟΣ ŉ "
    import unicodedata

    assert r["s"] == " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    assert r["w"] == " ".join(text.casefold().split()) and r["k"] == "ab strasse σίσυφοσ ʼn".replace("ʼ", "ʼ") and r["l"] == "mixed"


def test_casefold_of_every_letter(spark):
    letters = [chr(i) for i in range(32, 0x1E944) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    wrong = [r["c"] for r in df.select("c", norm.casefold("c").alias("f")).collect() if r["f"] != r["c"].casefold()]
    assert len(wrong) <= 60, wrong  # letters newer than one of the two Unicode versions


def test_library_log(spark):
    rows = [(1, 1, "save", "n", "unread", ["AI"], False, False, False), (1, 2, "save", None, "reading", ["ai", "ML"], False, False, False), (1, 3, "update", None, "read", ["x"], True, False, False), (2, 1, "save", "a", "read", ["q"], False, False, False), (2, 2, "delete", None, None, [], False, False, False), (2, 3, "update", "z", "read", [], True, True, True), (2, 4, "save", None, "unread", ["new"], False, False, False), (3, 1, "save", "a", "read", [], False, False, False), (3, 2, "delete", None, None, [], False, False, False)]
    df = spark.createDataFrame(rows, "item_key int, seq int, action string, note string, reading_status string, tags array<string>, has_note boolean, has_status boolean, has_tags boolean").withColumn("ts", F.col("seq"))
    got = {r["item_key"]: (r["note"], r["reading_status"], r["tags"], r["saved_at"], r["updated_at"]) for r in library.fold_log(df).collect()}
    assert got == {1: (None, "reading", ["AI", "ML"], 1, 3), 2: (None, "unread", ["new"], 4, 4)}


def test_backbone_keeps_only_what_no_other_way_shows(spark):
    nodes = spark.createDataFrame([(1, i, 2000, 0.5) for i in range(4)], "run_id int, id long, year int, relevance double")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 2, 3), (1, 3, 2)], "run_id int, src long, dst long")
    kept = {(r["src"], r["dst"]) for r in graph.reduced_edges(nodes, edges).where("retained").collect()}
    assert kept == {(0, 1), (1, 2), (2, 3), (3, 2)}
    protected = {(r["src"], r["dst"]) for r in graph.reduced_edges(nodes, edges, spark.createDataFrame([(1, 0)], "run_id int, id long")).where("retained").collect()}
    assert (0, 2) in protected


def test_cooldown(spark):
    requests = spark.createDataFrame([(i, "a", t) for i, t in enumerate((99, 100, 159, 160, 399, 400))], "request_id int, source string, t long")
    one = lambda wait: {r["request_id"] for r in lookup.in_cooldown(requests, spark.createDataFrame([("a", 100, wait)], "source string, t long, retry_after double")).collect()}
    assert one(None) == {1, 2} and one(9999.0) == {1, 2, 3, 4}


def test_queries(spark):
    known = spark.createDataFrame([("r", "deep graph learning methods survey")], "run_id string, query string")
    rows = [("r", 1, 1, "Survey methods learning graph deep"), ("r", 1, 2, "a b c d e"), ("r", 1, 3, "a b c d e f"), ("r", 2, 4, "!!"), ("r", 2, 5, "other words")]
    got = rounds.accept_queries(spark.createDataFrame(rows, "run_id string, gap int, pos int, query string"), known)
    assert {r["pos"]: r["accepted"] for r in got.collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_cap_of_a_gap_binds_only_what_it_accepts(spark):
    rows = [("r", 1, 1, "alpha"), ("r", 1, 2, "beta gamma"), ("r", 2, 3, "gamma beta"), ("r", 2, 4, "delta"), ("q", 5, 1, "alpha"), ("q", 6, 2, "ALPHA!"), ("q", 6, 3, "other")]
    df = spark.createDataFrame(rows, "run_id string, gap int, pos int, query string")
    known = spark.createDataFrame([("z", "none")], "run_id string, query string")
    got = rounds.accept_queries(df, known, 1)
    assert {(r["run_id"], r["pos"]) for r in got.where("accepted").collect()} == {("r", 1), ("r", 3), ("q", 1), ("q", 3)}
    gaps = spark.createDataFrame([("r", 1, "method", "a"), ("r", 2, "dataset", "b"), ("r", 3, "source", "c"), ("r", 4, "method", "d")], "run_id string, gap int, gap_type string, constraint string")
    report = rounds.evolution_report(gaps, got.where("run_id = 'r'")).collect()[0]
    assert (report["n_generated"], report["n_skipped"], report["warnings"]) == (2, 2, ["c: left to the controller", "d: no new query"])


def test_gate(spark):
    """Two English, short and new ones of a model; a run where none holds takes the rules' queries."""
    proposals = [("a", 1, "graph nets", "en"), ("a", 2, "nets graph", "en"), ("a", 3, "third one", "en"), ("b", 1, "auf deutsch", "de"), ("b", 2, " ", "en"), ("c", 1, "known query", "en"), ("c", 2, "x" * 301, "en")]
    rules = [(run, 1, f"rule {run}") for run in "abcd"]
    known = spark.createDataFrame([("c", "query known")], "run_id string, query string")
    got = rounds.gate_proposals(spark.createDataFrame(proposals, "run_id string, pos int, query string, language string"), spark.createDataFrame(rules, "run_id string, pos int, query string"), known)
    assert {(r["run_id"], r["query"], r["origin"]) for r in got.collect()} == {("a", "graph nets", "model"), ("b", "rule b", "rules"), ("c", "rule c", "rules"), ("d", "rule d", "rules")}


def test_cascade_without_vectors(spark):
    papers = spark.createDataFrame([(run, f"{run}{i}", "t", "", 2020, None, "article", 1.0 / i) for run in "ab" for i in (1, 2, 3)], "run_id string, paper_id string, title string, abstract string, year int, venue string, paper_type string, rrf_score double")
    vecs = spark.createDataFrame([(f"a{i}", [float(i), 0.0]) for i in (1, 2, 3)], "paper_id string, embedding array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0])], "run_id string, embedding array<double>")
    scores = spark.createDataFrame([], "run_id string, paper_id string, pair_score double")
    assessed = spark.createDataFrame([], "run_id string, paper_id string, batch int, item int, relevance double, status string, evidence array<string>, reason string")
    kept, counts = ranking.finalize(papers, vecs, queries, scores, assessed, spark.createDataFrame([("a", 2), ("b", 2)], "run_id string, target_count int"))
    assert [r["paper_id"] for r in kept.orderBy("run_id", "rank").collect()] == ["a3", "a2", "b1", "b2"]
    assert {r["run_id"]: (r["n_candidates"], r["n_semantic"], r["n_final"], r["n_truncated"], r["fallback"]) for r in counts.collect()} == {"a": (3, 3, 2, 1, False), "b": (3, 3, 2, 1, True)}


def test_rrf_checks(spark):
    prov = spark.createDataFrame([("r", 1, "a", 2)], "run_id string, component long, source string, best_rank int")
    for bad in (dict(k=0), dict(weights={"a": -1.0}), dict(weights={"a": float("nan")}), dict(weights={" ": 1.0}), dict(weights={"a": True})):
        with pytest.raises(ValueError):
            fusion.rrf(prov, **bad)


def test_platform_ids_join_records(spark):
    rows = [(*hit(1), "https://openalex.org/W5", None, None), (*hit(2, "dblp", title="x"), "w5", None, "conf/x"), (*hit(3, "arxiv", title="y"), None, "https://www.semanticscholar.org/paper/Name/ABC", "https://dblp.org/rec/conf/x.html"), (*hit(4, title="z"), "W6", None, None)]
    df = spark.createDataFrame(rows, HITS + ", openalex_id string, semantic_scholar_id string, dblp_key string")
    assert component(fusion.identity_groups(df)) == {1: 1, 2: 1, 3: 1, 4: 4}
    keys = {r["seq"]: r["k"] for r in df.select("seq", library.library_key(df).alias("k")).collect()}
    assert keys[3] == "semantic_scholar:https://www.semanticscholar.org/paper/name/abc" and keys[4] == "openalex:w6"


def test_repair_is_linear():
    import time

    began = time.process_time()
    repair('{"a": "' + 'x "y" ' * 200_000 + '"}')
    assert time.process_time() - began < 10


def test_payloads(spark):
    payload = '{"results":[{"id":"W1","title":"T","publication_year":true,"cited_by_count":-3,"abstract_inverted_index":{"b":[1],"a":[0,1]}},{"id":"W2"},{"id":"W3","title":"U","publication_year":2001,"doi":5,"ids":{"doi":"10.1/x"}}]}'
    raw = spark.createDataFrame([("r", 1, payload, None), ("r", 2, "not json", None)], "run_id string, round int, payload string, fetched_at timestamp")
    good, bad = split_bad(ingest_openalex(raw))
    assert [(r["paper_id"], r["raw_rank"], r["year"], r["citation_count"], r["abstract"], r["doi"]) for r in good.orderBy("raw_rank").collect()] == [("W1", 1, None, 0, "a b", None), ("W3", 3, 2001, 0, "", "10.1/x")]
    assert [r["raw_rank"] for r in bad.collect()] == [2]
    one = '{"result":{"hits":{"hit":{"info":{"key":"k","title":"A &lt;b&gt;x&lt;/b&gt; &amp; B","authors":{"author":{"text":"Ada"}},"year":"2020","type":"Workshop"}}}}}'
    r = ingest_dblp(spark.createDataFrame([("r", 1, one, None)], "run_id string, round int, payload string, fetched_at timestamp")).collect()[0]
    assert (r["title"], r["authors"][0]["name"], r["year"], r["paper_type"]) == ("A x & B", "Ada", 2020, "conference")


def test_response_pages(spark):
    from folium.plans import ingest
    from folium.sources.payloads import ingest_s2, unparsed

    rows = spark.range(250).selectExpr("if(id < 249, 'r', null) AS run_id", "1 AS round", "id * 37 AS seq", "id")
    raw = ingest._responses(rows.repartition(5), F.to_json(F.struct(F.col("id").cast("string").alias("paperId"))), ingest._list('{"data":[', "]}"))
    assert sorted((r["run_id"] or "", r["first_rank"], r["payload"].count("paperId")) for r in raw.collect()) == [("", 1, 1), ("r", 1, 100), ("r", 101, 100), ("r", 201, 49)]
    got = {(r["run_id"], r["paper_id"]): r["raw_rank"] for r in ingest_s2(raw).collect()}
    assert got == {("r", str(i)): i + 1 for i in range(249)} | {(None, "249"): 1}
    assert unparsed(raw).count() == 0
    assert [r["payload"] for r in unparsed(spark.createDataFrame([("[1]",), ("{",)], "payload string")).collect()] == ["{"]


def test_repair():
    import json

    for broken, want in (('{"a": "say "hi" now", "b": 1}', {"a": 'say "hi" now', "b": 1}), ('{"a": "line\nbreak"}', {"a": "line\nbreak"}), ('{"a": "c:\\dir"}', {"a": "c:\\dir"}), ('{"a": ["x "y", "z"]}', {"a": ['x "y', "z"]})):
        assert json.loads(repair(broken)) == want


def test_encoder_halves(spark):
    seen = []

    def fn(batch):
        if len(batch) > 2:
            raise MemoryError
        seen.append(len(batch))
        return [[1.0]] * len(batch)

    assert vectors._halving(fn, list("abcd"), 4) == [[1.0]] * 4 and seen == [2, 2]
    assert vectors._halving(lambda b: [[2.0]] * (len(b) - (len(b) == 4)), list("abcdefg"), 4) == [None] * 4 + [[2.0]] * 3


def test_encoder_of_another_length_gives_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b b"), (3, None)], "id long, text string").coalesce(1)
    whole = vectors.encode(df, vectors.hashing_encoder(4)).collect()
    assert [sum(r["embedding"]) for r in sorted(whole)] == [1.0, 2.0, 0.0]
    assert [r["embedding"] for r in vectors.encode(df, lambda: lambda texts: [[1.0]]).collect()] == [None] * 3
    assert [r["s"] for r in vectors.score_pairs(df, lambda: lambda pairs: [0.5] * len(pairs), "text", "text", "s").collect()] == [0.5] * 3


def test_no_cross_product_and_no_lone_window(spark, sf):
    from folium.plans import registry

    for name in ("p2_filter_reason", "f10_rrf", "r3_rank_pair", "c3_coverage_gaps", "j8_similar_queries", "j9_in_cooldown", "g4_filter_graph", "a1_facets", "p5_filter_library", "r10_term_search", "f12_dedup_first", "l3_fold_log"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        assert "Exchange SinglePartition" not in plan, name


def test_records_fused_before_meet_by_provenance(spark):
    from folium.operators.fusion import identity_groups

    rows = [(1, "openalex", "W1", [("openalex", "W1"), ("arxiv", " AX9 ")]), (2, "arxiv", "ax9", None), (3, "dblp", "ax9", []), (4, "s2", "W1", [("arxiv", ""), (None, "ax9"), ("dblp", None)]), (5, "pubmed", "5", [("openalex", "w1")])]
    hits = spark.createDataFrame([("r", i, s, p, r) for i, s, p, r in rows], "run_id string, seq long, source string, paper_id string, source_records array<struct<source: string, external_id: string>>")
    hits = hits.withColumns({c: F.lit(None).cast("string") for c in ("title", "first_author", "doi", "arxiv_id", "pmid")} | {"year": F.lit(2000)})
    assert {r["seq"]: r["component"] for r in identity_groups(hits).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_copies_of_one_query_are_one_class(spark):
    rows = spark.range(10_000).selectExpr("1L AS run_id", "id AS pos", "'graph neural networks for drug design' AS query").unionByName(spark.createDataFrame([(1, 10_000, "design drug graph neural networks for the"), (1, 10_001, ""), (1, 10_002, "!!"), (2, 1, "graph")], "run_id long, pos long, query string"))
    members, links = rounds.similar_classes(rows, 0.8)
    assert members.count() == 10_004 and [tuple(r) for r in links.collect()] == [(1, 10_000, 0, 6 / 7)]
    got = rounds.class_links(members, links)
    assert got.where("class = 0 and n_links = 1").count() == 10_000 and {(r["pos"], r["n_links"]) for r in got.where("run_id = 1 and pos > 10000").collect()} == {(10_001, 0), (10_002, 0)}


def test_pairs_of_classes_expand_to_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 7))) for _ in range(150)]
    want = {(a, b) for b, a in itertools.combinations(range(150), 2) if (x := set(texts[a].split())) and (y := set(texts[b].split())) and len(x & y) / len(x | y) >= 0.6}
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "run_id long, pos long, query string")
    got = [(r["a"], r["b"]) for r in rounds.similar_queries(df, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_chain_is_settled_by_blocks(spark, monkeypatch):
    from folium.operators import components as c

    n, rounds, real = 5000, [], c.Steps.put
    monkeypatch.setattr(c.Steps, "put", lambda self, df: rounds.append(1) or real(self, df))
    rows = spark.range(n).selectExpr("1L AS run_id", "id")
    chain = spark.range(n - 1).selectExpr("1L AS run_id", "id AS a", "id + 1 AS b")
    got = greedy_keep(rows, chain, ["run_id"])
    assert {r["id"] for r in got.where("kept").collect()} == set(range(0, n, 2)) and len(rounds) < 20


def test_blocks_follow_the_sequential_rule(spark):
    import random

    rng = random.Random(6)
    n = 120
    pairs = [(rng.randrange(3), *rng.sample(range(n), 2)) for _ in range(500)]
    want = set()
    for run in range(3):
        kept = set()
        for i in range(n):
            if not any(r == run and ((a == i and b in kept) or (b == i and a in kept)) for r, a, b in pairs):
                kept.add(i)
        want |= {(run, i) for i in kept}
    rows = spark.createDataFrame([(r, i) for r in range(3) for i in range(n)], "run_id long, id long")
    got = greedy_keep(rows, spark.createDataFrame(pairs, "run_id long, a long, b long"), ["run_id"], block=16)
    assert {(r["run_id"], r["id"]) for r in got.where("kept").collect()} == want and got.count() == 3 * n


def test_rows_without_conflicts_are_kept_at_once(spark):
    """A row for each of many runs: no Python group for each."""
    rows, none = spark.range(50).selectExpr("id as run_id", "id * 7 as id"), spark.createDataFrame([], "run_id long, a long, b long")
    kept = greedy_keep(rows, none, ["run_id"])
    assert "Pandas" not in kept._jdf.queryExecution().executedPlan().toString() and kept.where("kept").count() == 50


def test_small_blocks_of_many_keys_are_settled_together(spark, monkeypatch):
    """Chains of three in 400 runs, and a row apart in each: the deals are of about a block of rows."""
    rows = spark.range(400 * 4).selectExpr("id % 400 as run_id", "floor(id / 400) as id")
    chain = spark.range(400 * 2).selectExpr("id % 400 as run_id", "floor(id / 400) as a", "floor(id / 400) + 1 as b")
    deals = []
    original = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: deals.append(self._df.select("deal").distinct().count()) or original(self, f, schema))
    got = greedy_keep(rows, chain, ["run_id"], block=100)
    assert {(r["id"], r["kept"]) for r in got.collect()} == {(0, True), (1, False), (2, True), (3, True)} and got.count() == 1600
    assert len(deals) == 1 and deals[0] <= 13
