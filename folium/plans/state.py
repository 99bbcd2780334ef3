"""Registered queries of libraries, reports, lookups and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import facets, filters, lookup, reports, vectors
from folium.operators import library as lib
from folium.plans import fusion as pf
from folium.plans import search as ps
from folium.plans import sql as s
from folium.plans.fixtures import query, table, view
from folium.sources.buckets import Buckets, upsert
from folium.sources.store import append, latest, scratch

_LOG = "SELECT item_key, seq, ts, action, note, reading_status, keyword, seq % 2 = 0 AS has_note, seq % 3 = 0 AS has_status, seq % 5 = 0 AS has_tags FROM fx_library_log"


def log(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, _LOG).withColumns({"tags": F.array("keyword", F.concat(F.upper(F.substring("keyword", 1, 1)), F.substring("keyword", 2, 9))), "paper_id": F.concat(F.lit("p"), "seq")})


def library(spark: SparkSession, d: str) -> DataFrame:
    """The folded library joined with its papers: item_key is a document's number."""
    papers = view(spark, d, "fx_papers").select(F.col("seq").alias("item_key"), "paper_id", "title", "year", "venue", F.array(F.initcap("source"), "lang").alias("keywords"))
    return lib.fold_log(log(spark, d)).join(papers, "item_key")


#: The same library for DuckDB: items(item_key, note, reading_status, saved_at, updated_at, tags)
_FOLD = f"""lg AS ({_LOG}), ep AS (SELECT *, count(*) FILTER (action = 'delete') OVER (PARTITION BY item_key ORDER BY seq) AS e FROM lg),
  l1 AS (SELECT *, max(e) OVER (PARTITION BY item_key) AS m FROM ep), l2 AS (SELECT *, min(CASE WHEN action = 'save' THEN seq END) OVER (PARTITION BY item_key) AS f FROM l1 WHERE e = m AND action <> 'delete'),
  l3 AS (SELECT *, coalesce(max(CASE WHEN action = 'update' AND has_tags THEN seq END) OVER (PARTITION BY item_key), f) AS base FROM l2 WHERE seq >= f),
  tg AS (SELECT item_key, keyword, min(seq) AS o FROM l3 WHERE seq >= base AND (action = 'save' OR has_tags) GROUP BY ALL),
  ta AS (SELECT item_key, string_agg(keyword, ',' ORDER BY o) AS tags FROM tg GROUP BY item_key),
  it AS (SELECT item_key, (arg_max(ROW(note), seq) FILTER ((action = 'save' AND note IS NOT NULL) OR (action = 'update' AND has_note)))[1] AS note,
    coalesce(arg_max(reading_status, seq) FILTER ((action = 'save' AND reading_status <> 'unread') OR (action = 'update' AND has_status)), 'unread') AS reading_status, min(ts) AS saved_at, max(ts) AS updated_at FROM l3 GROUP BY item_key),
  items AS (SELECT it.*, coalesce(ta.tags, '') AS tags FROM it LEFT JOIN ta ON ta.item_key = it.item_key),
  lb AS (SELECT items.*, p.paper_id, p.title, p.year, p.venue, p.source, p.lang FROM items JOIN fx_papers p ON p.seq = items.item_key)"""

_REQ = """SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'reading' WHEN 1 THEN 'read' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 2000 END AS year_from, CASE WHEN o_orderkey % 5 = 0 THEN 2018 END AS year_to,
  CASE WHEN o_orderkey % 7 = 0 THEN 'SRC1' END AS venue, CASE WHEN o_orderkey % 2 = 0 THEN concat('KW', o_custkey % 13) END AS keyword FROM orders WHERE o_orderkey % 50 = 0"""
_FOUND = "(q.status IS NULL OR lb.reading_status = q.status) AND (q.year_from IS NULL OR lb.year >= q.year_from) AND (q.year_to IS NULL OR lb.year <= q.year_to) AND (q.venue IS NULL OR contains(lower(lb.venue), lower(q.venue)))"


def _resolve(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    requests = query(spark, d, "SELECT o_orderkey AS request_id, array(concat('doc:', o_custkey), concat('doc:', CAST(floor(o_orderkey / 16.0) AS BIGINT)), concat('doc:', o_custkey % 300)) AS ids, CASE WHEN o_orderkey % 2 = 0 THEN 'all' ELSE 'results' END AS scope FROM orders")
    stored = query(spark, d, "SELECT paper_id, title, run_id, seq, CAST(round AS BIGINT) AS updated_at FROM fx_results WHERE seq % 2 = 0")
    return requests, lookup.resolve_papers(requests, stored, library(spark, d))


_RESOLVE = f"""WITH {_FOLD}, rq AS (SELECT o_orderkey AS request_id, ['doc:' || o_custkey, 'doc:' || CAST(floor(o_orderkey / 16.0) AS BIGINT), 'doc:' || (o_custkey % 300)] AS ids, o_orderkey % 2 = 0 AS alls FROM orders),
  ex AS (SELECT request_id, alls, ids, CAST(i - 1 AS INT) AS position, ids[i] AS paper_id FROM rq, (SELECT unnest([1, 2, 3]) AS i) z),
  st AS (SELECT DISTINCT paper_id, title FROM fx_results WHERE seq % 2 = 0),
  rs AS (SELECT request_id, position, ex.paper_id, CASE WHEN st.paper_id IS NOT NULL THEN 'results' WHEN alls AND lb.paper_id IS NOT NULL THEN 'library' END AS origin, coalesce(st.title, lb.title) AS title FROM ex LEFT JOIN st ON st.paper_id = ex.paper_id LEFT JOIN lb ON lb.paper_id = ex.paper_id)"""

_CALLS = "SELECT call_id, run_id, occurred_at_utc, model, prompt_tokens, completion_tokens, cache_hit_tokens, CAST(NULL AS BIGINT) AS cache_miss_tokens, event_type FROM fx_usage"
_COST = """cs AS (SELECT call_id, run_id, prompt_tokens, completion_tokens, least(greatest(prompt_tokens, 0), greatest(cache_hit_tokens, 0)) AS h, greatest(prompt_tokens, 0) AS pt, greatest(completion_tokens, 0) AS ct,
    CASE model WHEN 'deepseek-chat' THEN 'deepseek-v4-flash' ELSE model END AS m, (extract(hour FROM occurred_at_utc + INTERVAL 8 HOUR) * 60 + extract(minute FROM occurred_at_utc + INTERVAL 8 HOUR)) AS mi FROM fx_usage),
  ck AS (SELECT *, m <> 'unknown' AND ((mi >= 540 AND mi < 720) OR (mi >= 840 AND mi < 1080)) AS peak FROM cs),
  cc AS (SELECT *, CASE m WHEN 'deepseek-v4-flash' THEN ((h * 2 + (pt - h) * 100 + ct * 200) * CASE WHEN peak THEN 2 ELSE 1 END) / 1e8 WHEN 'deepseek-v4-pro' THEN (((h * 25 + (pt - h) * 3000 + ct * 6000) * CASE WHEN peak THEN 2 ELSE 1 END + 5) // 10) / 1e8 ELSE 0 END AS cost FROM ck)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_keywords").select("run_id", "seq", "pos", "paper_id", F.col("keyword").alias("term"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "SELECT vec_id, concat('ix', vec_id % 2) AS index_name, concat('doc:', CAST(floor(vec_id / 4.0) AS BIGINT)) AS paper_id, concat('h', CAST(floor(vec_id / 4.0) AS BIGINT) % 7) AS text_hash, embedding, status FROM fx_vectors")


def i12_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Puts the run log's parts into a table in buckets of runs, which has each run's last row."""
    runs = query(spark, d, "SELECT run_id % 1000 AS run_id, updated_at, latency_ms, status, run_id AS seq FROM fx_runs")
    store = Buckets(spark, scratch(spark, "run-states"), {"runs": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)}, ["run_id"])
    for version, part in enumerate((1, 0)):
        upsert(store, version, "runs", runs.where(f"seq % 2 = {part}"), ["run_id"], ["updated_at", "seq"])
    return store.read("runs")


def i12(spark: SparkSession, d: str) -> DataFrame:
    """Appends the run log in two parts and reads its latest view."""
    path = scratch(spark, "run-log")
    runs = query(spark, d, "SELECT run_id % 1000 AS run_id, updated_at, latency_ms, status, run_id AS seq FROM fx_runs")
    append(runs.where("seq % 2 = 0"), path)
    append(runs.where("seq % 2 = 1"), path)
    return latest(spark.read.schema(runs.schema).parquet(path), ["run_id"], ["updated_at", "seq"])


_ROUTES = """e AS (SELECT run_id, paper_id, seq * 10 + pos AS o, trim(keyword) AS t, replace(lower(trim(keyword)), 'ß', 'ss') AS route FROM fx_keywords WHERE trim(keyword) <> ''), p AS (SELECT run_id, route, paper_id, min(o) AS o, arg_min(t, o) AS t FROM e GROUP BY ALL)"""

QUERIES = {
    "l1_library_key": (
        lambda spark, d: view(spark, d, "fx_papers").select("seq", lib.library_key(view(spark, d, "fx_papers")).alias("k")),
        "SELECT seq, CASE WHEN trim(doi) <> '' THEN concat('doi:', trim(regexp_replace(lower(trim(doi)), '^(https?://doi\\.org/|doi:)', ''))) WHEN trim(arxiv_id) <> '' THEN concat('arxiv:', lower(trim(arxiv_id))) WHEN trim(pmid) <> '' THEN concat('pmid:', lower(trim(pmid))) WHEN trim(openalex_id) <> '' THEN concat('openalex:', lower(trim(openalex_id))) WHEN trim(semantic_scholar_id) <> '' THEN concat('semantic_scholar:', lower(trim(semantic_scholar_id))) WHEN trim(dblp_key) <> '' THEN concat('dblp:', lower(trim(dblp_key))) ELSE concat('paper:', lower(trim(paper_id))) END AS k FROM fx_papers",
    ),
    "l2_fold_saves": (
        lambda spark, d: lib.fold_saves(log(spark, d).where("action = 'save'")).withColumn("tags", F.array_join("tags", ",")),
        """WITH s AS (SELECT * FROM fx_library_log WHERE action = 'save'), t AS (SELECT item_key, keyword, min(seq) AS o FROM s GROUP BY ALL), g AS (SELECT item_key, string_agg(keyword, ',' ORDER BY o) AS tags FROM t GROUP BY item_key)
        SELECT s.item_key, concat('p', max(seq)) AS paper_id, arg_max(note, seq) FILTER (note IS NOT NULL) AS note, coalesce(arg_max(reading_status, seq) FILTER (reading_status <> 'unread'), 'unread') AS reading_status, min(ts) AS saved_at, max(ts) AS updated_at, count(*) AS n_saves, any_value(g.tags) AS tags FROM s JOIN g ON g.item_key = s.item_key GROUP BY s.item_key""",
    ),
    "l2_created": (lambda spark, d: lib.created(log(spark, d).where("action = 'save'")).where("created").select("item_key", "seq"), "SELECT item_key, min(seq) AS seq FROM fx_library_log WHERE action = 'save' GROUP BY item_key"),
    "l3_fold_log": (lambda spark, d: lib.fold_log(log(spark, d)).withColumn("tags", F.array_join("tags", ",")), f"WITH {_FOLD} SELECT * FROM items"),
    "l3_merged_parts": (
        lambda spark, d: lib.folded_items(lib.merged_parts(lib.log_parts(log(spark, d), F.floor(F.col("seq") / 300)), F.floor(F.col("segment") / 7))).drop("paper_id", "n_saves").withColumn("tags", F.array_join("tags", ",")),
        f"WITH {_FOLD} SELECT * FROM items",
    ),
    "l4_latest_states": (
        lambda spark, d: lib.latest_states(query(spark, d, "SELECT run_id % 500 AS run_id, updated_at, run_id AS seq, status, 'heavy' AS payload FROM fx_runs WHERE run_id % 500 <> run_id % 499"), ("payload",)).select("run_id", "updated_at"),
        "SELECT run_id % 500 AS run_id, max(updated_at) AS updated_at FROM fx_runs WHERE run_id % 500 <> run_id % 499 GROUP BY run_id % 500",
    ),
    "l5_reconcile": (
        lambda spark, d: lib.reconcile(query(spark, d, "SELECT run_id, status, CASE WHEN status = 'completed' THEN 'done' END AS stop_reason, CASE WHEN run_id % 2 = 0 THEN array('e') ELSE array('interrupted: the process ended before the run did') END AS errors FROM fx_runs")).withColumn("errors", F.array_join("errors", "|")),
        f"SELECT run_id, CASE WHEN status = 'completed' THEN status ELSE 'failed' END AS status, CASE WHEN status = 'completed' THEN 'done' ELSE '{lib.INTERRUPTED}' END AS stop_reason, CASE WHEN run_id % 2 = 1 THEN '{lib.INTERRUPTED}' WHEN status = 'completed' THEN 'e' ELSE 'e|{lib.INTERRUPTED}' END AS errors FROM fx_runs",
    ),
    "l6_delete_runs": (
        lambda spark, d: (lambda v, st, rs: v.select(F.concat(F.lit("v"), "request_id").alias("x"), "verdict").unionByName(st.select(F.concat(F.lit("s"), "run_id").alias("x"), F.lit("state").alias("verdict"))).unionByName(rs.select(F.concat(F.lit("r"), "run_id").alias("x"), F.lit("result").alias("verdict"))))(
            *lib.delete_runs(view(spark, d, "fx_runs"), query(spark, d, "SELECT run_id FROM fx_runs WHERE run_id % 3 = 0"), query(spark, d, "SELECT o_orderkey AS request_id, o_orderkey * 2 AS run_id FROM orders WHERE o_orderkey % 5 = 0"))),
        """WITH q AS (SELECT o_orderkey AS request_id, o_orderkey * 2 AS run_id FROM orders WHERE o_orderkey % 5 = 0), v AS (SELECT request_id, q.run_id, CASE WHEN f.run_id IS NULL THEN 'missing' WHEN status IN ('pending', 'running') THEN 'active' ELSE 'deleted' END AS verdict FROM q LEFT JOIN fx_runs f ON f.run_id = q.run_id),
        g AS (SELECT run_id FROM v WHERE verdict = 'deleted') SELECT concat('v', request_id) AS x, verdict FROM v UNION ALL SELECT concat('s', run_id), 'state' FROM fx_runs WHERE run_id NOT IN (SELECT run_id FROM g) UNION ALL SELECT concat('r', run_id), 'result' FROM fx_runs WHERE run_id % 3 = 0 AND run_id NOT IN (SELECT run_id FROM g)""",
    ),
    "p5_filter_library": (
        lambda spark, d: filters.filter_library(library(spark, d), query(spark, d, _REQ)).select("request_id", "item_key"),
        f"WITH {_FOLD}, q AS ({_REQ}) SELECT request_id, item_key FROM q JOIN lb ON {_FOUND} AND (q.keyword IS NULL OR list_contains(string_split(lower(concat(lb.tags, ',', lb.source, ',', lb.lang)), ','), lower(q.keyword)))",
    ),
    "a1_facets": (
        lambda spark, d: facets.facets(library(spark, d), query(spark, d, _REQ)).select("request_id", F.lower("keyword").alias("keyword"), "count", "rank"),
        f"""WITH {_FOLD}, q AS ({_REQ}), x AS (SELECT DISTINCT request_id, item_key, unnest(string_split(lower(concat(lb.tags, CASE WHEN lb.tags = '' THEN '' ELSE ',' END, lb.source, ',', lb.lang)), ',')) AS keyword FROM q JOIN lb ON {_FOUND}),
        c AS (SELECT request_id, keyword, count(*) AS "count" FROM x GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY "count" DESC, keyword) AS rank FROM c) SELECT * FROM k WHERE rank <= 80""",
    ),
    "a2_top_keywords": (
        lambda spark, d: reports.top_keywords(_terms(spark, d)),
        """WITH t AS (SELECT run_id, paper_id, trim(keyword) AS t, min(seq) AS seq FROM fx_keywords WHERE trim(keyword) <> '' GROUP BY ALL), c AS (SELECT run_id, replace(lower(t), 'ß', 'ss') AS k, count(*) AS "count", arg_min(t, ROW(seq, t)) AS keyword FROM t GROUP BY ALL),
        r AS (SELECT run_id, keyword, "count", row_number() OVER (PARTITION BY run_id ORDER BY "count" DESC, k) AS rank FROM c) SELECT * FROM r WHERE rank <= 8""",
    ),
    "a3_source_report": (
        lambda spark, d: reports.source_report(query(spark, d, "SELECT run_id, source, seq FROM fx_results WHERE seq % 3 = 0"), query(spark, d, "SELECT run_id, source, count(*) AS n, min(seq) AS at FROM fx_hits WHERE source <> 'arxiv' GROUP BY run_id, source"), query(spark, d, "SELECT run_id, source, max(seq) AS at FROM fx_hits WHERE source IN ('dblp', 'pubmed') GROUP BY run_id, source")),
        """WITH f AS (SELECT run_id, source, count(*) AS n, min(seq) AS a FROM fx_results WHERE seq % 3 = 0 GROUP BY ALL), c AS (SELECT run_id, source, count(*) AS n, min(seq) AS a FROM fx_hits WHERE source <> 'arxiv' GROUP BY ALL), s AS (SELECT run_id, source, max(seq) AS a FROM fx_hits WHERE source IN ('dblp', 'pubmed') GROUP BY ALL),
        u AS (SELECT run_id, source FROM f UNION SELECT run_id, source FROM c UNION SELECT run_id, source FROM s)
        SELECT u.run_id, u.source, coalesce(c.n, 0) AS recalled, coalesce(f.n, 0) AS final, row_number() OVER (PARTITION BY u.run_id ORDER BY s.a NULLS LAST, c.a NULLS LAST, f.a NULLS LAST, u.source) AS position FROM u LEFT JOIN f ON f.run_id = u.run_id AND f.source = u.source LEFT JOIN c ON c.run_id = u.run_id AND c.source = u.source LEFT JOIN s ON s.run_id = u.run_id AND s.source = u.source""",
    ),
    "a4_synthesis": (
        lambda spark, d: reports.synthesis(ps.results(spark, d), query(spark, d, "SELECT run_id, CAST(NULL AS BIGINT) AS n_high, CASE WHEN run_id NOT LIKE 'r1-%' THEN count(*) END AS n_partial, CASE WHEN run_id LIKE 'r2-%' THEN array('a', 'b', 'c', 'd') ELSE array() END AS gaps, CASE WHEN run_id NOT LIKE 'r3-%' THEN 'budget' END AS stop_reason FROM fx_hits WHERE run_id NOT LIKE 'r4-%' GROUP BY run_id")).withColumns({"findings": F.array_join("findings", "|"), "suggestions": F.array_join("suggestions", "|")}),
        """WITH c AS (SELECT run_id, CASE WHEN run_id NOT LIKE 'r1-%' THEN count(*) END AS np FROM fx_hits WHERE run_id NOT LIKE 'r4-%' GROUP BY run_id),
        n AS (SELECT run_id, count(*) AS n_papers, count_if(coalesce(status = 'satisfied', false)) AS n_high, count_if(coalesce(status = 'uncertain', false)) AS u, min(year) AS first_year, max(year) AS last_year, count(DISTINCT source) AS n_sources FROM fx_results GROUP BY run_id),
        j AS (SELECT n.*, coalesce(np, u) AS n_partial, c.run_id IS NOT NULL AS has FROM n LEFT JOIN c ON c.run_id = n.run_id)
        SELECT run_id, n_papers, n_high, n_partial, first_year, last_year, n_sources, concat_ws('|', concat(n_papers, ' papers kept, ', n_high, ' satisfy the constraints'), CASE WHEN n_partial > 0 THEN concat(n_partial, ' papers uncertain') END, CASE WHEN first_year IS NOT NULL THEN concat('published ', first_year, ' to ', last_year) END, concat(n_sources, ' sources took part')) AS findings,
          CASE WHEN run_id LIKE 'r2-%' THEN 'search more for a|search more for b|search more for c' WHEN has AND run_id NOT LIKE 'r3-%' THEN 'stopped: budget' ELSE '' END AS suggestions FROM j""",
    ),
    "a5_keyword_routes": (
        lambda spark, d: reports.keyword_routes(_terms(spark, d))[0].withColumn("representatives", F.array_join("representatives", ",")),
        f"WITH {_ROUTES} SELECT run_id, route, arg_min(t, o) AS name, count(*) AS n, array_to_string((list(paper_id ORDER BY o, paper_id))[1:3], ',') AS representatives, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, route) AS rank FROM p GROUP BY run_id, route",
    ),
    "a5_route_papers": (
        lambda spark, d: reports.keyword_routes(_terms(spark, d))[1],
        f"WITH {_ROUTES} SELECT run_id, route, row_number() OVER (PARTITION BY run_id, route ORDER BY o, paper_id) AS position, paper_id FROM p",
    ),
    "a6_call_cost": (lambda spark, d: reports.call_cost(query(spark, d, _CALLS)).select("call_id", "cost", "peak"), f"WITH {_COST} SELECT call_id, CAST(cost AS DOUBLE) AS cost, peak FROM cc"),
    "a7_run_usage": (
        lambda spark, d: reports.run_usage(reports.call_cost(query(spark, d, _CALLS)), query(spark, d, "SELECT run_id, 1 + call_id % 3 AS n_requests, call_id % 4 AS n_cache_hits, call_id % 100 AS latency_ms FROM fx_usage WHERE event_type <> 'error'")),
        f"""WITH {_COST}, o AS (SELECT run_id, sum(greatest(1 + call_id % 3 - call_id % 4, 0)) AS api_calls, sum(call_id % 4) AS cache_hits, sum(call_id % 100) AS latency_ms FROM fx_usage WHERE event_type <> 'error' GROUP BY run_id)
        SELECT cc.run_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost), 8) AS cost, bool_or(peak) AS peak, CAST(coalesce(any_value(api_calls), 0) AS BIGINT) AS api_calls, CAST(coalesce(any_value(cache_hits), 0) AS BIGINT) AS cache_hits, CAST(coalesce(any_value(latency_ms), 0) AS BIGINT) AS latency_ms FROM cc LEFT JOIN o ON o.run_id = cc.run_id GROUP BY cc.run_id""",
    ),
    "a8_funnel": (
        lambda spark, d: reports.funnel(pf.groups(spark, d), filters.filter_report(filters.filter_reason(view(spark, d, "fx_hits"), ps.intents(spark, d))), query(spark, d, "SELECT run_id, source FROM fx_hits WHERE seq % 97 = 0"), query(spark, d, "SELECT run_id, seq % 3 = 0 AS hit FROM fx_hits")).withColumn("source_errors", F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries("source_errors")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","), F.lit(""))).withColumn("sources", F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")),
        f"""WITH RECURSIVE {s.GROUPS}, {ps._MATCH.format(hits='fx_hits').removeprefix('WITH ')}, f AS (SELECT run_id, paper_id, {ps._REASON} AS fr FROM t),
        r AS (SELECT run_id, count_if(fr IS NOT NULL) AS filtered, count_if(fr IS NULL) AS kept, count(DISTINCT CASE WHEN fr IS NULL THEN paper_id END) AS families FROM f GROUP BY run_id),
        b AS (SELECT run_id, string_agg(concat(source, '=', n), ',' ORDER BY source) AS sources FROM (SELECT run_id, source, count(*) AS n FROM fx_hits GROUP BY ALL) GROUP BY run_id),
        n2 AS (SELECT run_id, count(*) AS normalized, count(DISTINCT component) AS deduplicated, count_if(seq % 97 = 0) AS errors, count_if(seq % 3 = 0) AS cache_hits, coalesce((SELECT string_agg(concat(source, '=', n), ',' ORDER BY source) FROM (SELECT x.run_id, source, count(*) AS n FROM fx_hits x WHERE seq % 97 = 0 GROUP BY ALL) y WHERE y.run_id = g.run_id), '') AS source_errors FROM g GROUP BY run_id)
        SELECT n2.run_id, normalized, deduplicated, normalized - deduplicated AS merged, sources, filtered, kept, families, errors, cache_hits, source_errors FROM n2 JOIN r ON r.run_id = n2.run_id JOIN b ON b.run_id = n2.run_id""",
    ),
    "a9_simple_counts": (
        lambda spark, d: reports.simple_counts(view(spark, d, "fx_papers"), query(spark, d, "SELECT DISTINCT run_id, coalesce(doi, paper_id) AS k FROM fx_papers"), query(spark, d, "SELECT run_id FROM fx_papers WHERE year > 2000")),
        "SELECT run_id, count(*) AS recalled, count(DISTINCT coalesce(doi, paper_id)) AS deduplicated, count_if(coalesce(year > 2000, false)) AS filtered FROM fx_papers GROUP BY run_id",
    ),
    "n12_comparison_items": (
        lambda spark, d: reports.comparison_items(view(spark, d, "fx_papers").withColumn("sources", F.array("source", "lang", "source"))).withColumn("sources", F.array_join("sources", ",")),
        "SELECT run_id, paper_id, concat_ws(' · ', first_author, coalesce(CAST(year AS VARCHAR), 'unknown year'), coalesce(venue, 'unknown venue'), paper_type) AS line, concat(source, ',', lang) AS sources FROM fx_papers",
    ),
    "j1_latest_papers": (
        lambda spark, d: lookup.latest_papers(query(spark, d, "SELECT concat('p', o_custkey) AS paper_id, o_orderkey AS run_id, o_orderkey AS seq, o_orderdate AS updated_at, o_totalprice FROM orders")).select("paper_id", "run_id", "o_totalprice"),
        "WITH r AS (SELECT concat('p', o_custkey) AS paper_id, o_orderkey AS run_id, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT paper_id, run_id, o_totalprice FROM r WHERE n = 1",
    ),
    "j2_resolve_papers": (lambda spark, d: _resolve(spark, d)[1], _RESOLVE + " SELECT * FROM rs WHERE origin IS NOT NULL"),
    "j3_incomplete_requests": (
        lambda spark, d: lookup.incomplete_requests(*_resolve(spark, d)),
        _RESOLVE + ", c AS (SELECT ex.request_id, any_value(len(list_distinct(ex.ids))) AS dn, count(rs.origin) AS n FROM ex JOIN rs ON rs.request_id = ex.request_id AND rs.position = ex.position GROUP BY ex.request_id) SELECT request_id, CASE WHEN dn < 3 THEN 'repeated' ELSE 'missing' END AS reason FROM c WHERE dn < 3 OR n < 3",
    ),
    "j4_run_history": (
        lambda spark, d: lookup.run_history(view(spark, d, "fx_runs"), query(spark, d, "SELECT l_orderkey AS run_id FROM lineitem WHERE l_quantity > 25"), 200, query(spark, d, "SELECT run_id FROM fx_runs WHERE run_id % 9 = 0")).select("run_id", "updated_at", "status", "result_ready"),
        "SELECT run_id, updated_at, status, run_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AS result_ready FROM fx_runs WHERE run_id % 9 <> 0 ORDER BY updated_at DESC, run_id LIMIT 200",
    ),
    "j6_map_vector_hits": (
        lambda spark, d: lookup.map_vector_hits(query(spark, d, "SELECT vec_id % 10 AS query_id, vec_id, round(embedding[0], 6) AS score FROM fx_vectors"), view(spark, d, "fx_vectors"), query(spark, d, "SELECT paper_id, seq % 40 AS item_key FROM fx_papers WHERE seq % 3 <> 0"), 5),
        "WITH h AS (SELECT v.vec_id % 10 AS query_id, p.seq % 40 AS item_key, max(round(v.embedding[1], 6)) AS score FROM fx_vectors v JOIN fx_papers p ON p.paper_id = v.paper_id AND p.seq % 3 <> 0 WHERE v.status = 'active' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_key) AS rank FROM h) SELECT * FROM k WHERE rank <= 5",
    ),
    "j7_translation_worklist": (
        lambda spark, d: lookup.translation_worklist(query(spark, d, "SELECT doc_id AS id, 'abstract' AS field, text FROM documents"), query(spark, d, "SELECT doc_id AS id, 'abstract' AS field, sha2(CASE WHEN doc_id % 3 = 0 THEN text ELSE 'old' END, 256) AS text_hash, concat('t', doc_id) AS translation FROM documents WHERE doc_id % 2 = 0")).select("id", "text_hash", "translation"),
        "SELECT doc_id AS id, sha256(text) AS text_hash, CASE WHEN doc_id % 6 = 0 THEN concat('t', doc_id) END AS translation FROM documents",
    ),
    "j7_discovery_id": (lambda spark, d: table(spark, d, "pages").select("page_id", F.lit("tavily").alias("s"), "url").select("page_id", lookup.discovery_id("s", "url").alias("id")), "SELECT page_id, sha256(concat('tavily', chr(10), url)) AS id FROM pages"),
    "j9_in_cooldown": (
        lambda spark, d: lookup.in_cooldown(query(spark, d, "SELECT event_id AS request_id, concat('s', user_id % 5) AS source, CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP))) AS BIGINT) AS t FROM events WHERE event_type <> 'error'"), query(spark, d, "SELECT concat('s', user_id % 5) AS source, CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP))) AS BIGINT) AS t, event_id % 500 AS retry_after FROM events WHERE event_type = 'error'")),
        """WITH e AS (SELECT event_id, concat('s', user_id % 5) AS source, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events), p AS (SELECT source, t, t + greatest(30, greatest(60, least(event_id % 500, 300))) AS until FROM e WHERE event_type = 'error')
        SELECT e.event_id AS request_id, e.source, e.t, max(p.until) AS until FROM e JOIN p ON p.source = e.source AND e.t >= p.t AND e.t < p.until WHERE e.event_type <> 'error' GROUP BY ALL""",
    ),
    "v1_audit_vectors": (
        lambda spark, d: vectors.audit_vectors(table(spark, d, "embeddings").withColumn("embedding", F.expr("CASE vec_id % 50 WHEN 1 THEN slice(embedding, 1, 10) WHEN 2 THEN transform(embedding, x -> CAST(0 AS FLOAT)) WHEN 3 THEN transform(embedding, x -> CAST('NaN' AS FLOAT)) ELSE embedding END")).withColumn("vec_id", F.expr("CASE WHEN vec_id % 100 = 7 THEN -vec_id ELSE vec_id END")), 64),
        "SELECT CASE WHEN vec_id % 100 = 7 THEN -vec_id ELSE vec_id END AS vec_id, CASE WHEN vec_id % 100 = 7 THEN 'id' WHEN vec_id % 50 = 1 THEN 'dimension' WHEN vec_id % 50 = 2 THEN 'zero' ELSE 'not_finite' END AS error FROM embeddings WHERE vec_id % 100 = 7 OR vec_id % 50 IN (1, 2, 3)",
    ),
    "v2_l2_normalize": (
        lambda spark, d: vectors.l2_normalize(table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 3))).select("vec_id", F.round(F.col("embedding")[0], 5).alias("a"), F.round(F.col("embedding")[63], 5).alias("z")),
        "WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings) SELECT vec_id, round(e[1] / l, 5) AS a, round(e[64] / l, 5) AS z FROM n",
    ),
    "v3_embedding_worklist": (
        lambda spark, d: vectors.embedding_worklist(query(spark, d, "SELECT paper_id, concat('h', seq % 5) AS text_hash FROM fx_papers"), _records(spark, d), "ix0"),
        "WITH r AS (SELECT concat('doc:', CAST(floor(vec_id / 4.0) AS BIGINT)) AS paper_id, concat('h', CAST(floor(vec_id / 4.0) AS BIGINT) % 7) AS text_hash, bool_or(status = 'active') AS a FROM fx_vectors WHERE vec_id % 2 = 0 AND status IN ('active', 'pending') GROUP BY ALL) SELECT p.paper_id, concat('h', p.seq % 5) AS text_hash, CASE WHEN a THEN 'reuse' WHEN a IS NOT NULL THEN 'wait' ELSE 'encode' END AS work FROM fx_papers p LEFT JOIN r ON r.paper_id = p.paper_id AND r.text_hash = concat('h', p.seq % 5)",
    ),
    "v4_apply_transitions": (
        lambda spark, d: vectors.apply_transitions(query(spark, d, "SELECT concat('ix', user_id % 3) AS index_name, concat('p', user_id) AS paper_id, event_id % 4 AS vec_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'reserve' ELSE 'activate' END AS event FROM events")),
        """WITH l AS (SELECT concat('ix', user_id % 3) AS index_name, concat('p', user_id) AS paper_id, event_id % 4 AS vec_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'reserve' ELSE 'activate' END AS event FROM events),
        z AS (SELECT index_name, paper_id, vec_id, arg_max(event, seq) AS event, max(CASE WHEN event = 'activate' THEN seq END) AS a FROM l GROUP BY ALL), n AS (SELECT *, max(CASE WHEN event = 'activate' THEN a END) OVER (PARTITION BY index_name, paper_id) AS m FROM z)
        SELECT index_name, paper_id, vec_id, CASE event WHEN 'fail' THEN 'failed' WHEN 'reserve' THEN 'pending' ELSE CASE WHEN a = m THEN 'active' ELSE 'inactive' END END AS status FROM n""",
    ),
    "v5_index_metadata": (lambda spark, d: vectors.index_metadata(_records(spark, d)), "SELECT concat('ix', vec_id % 2) AS index_name, count(*) AS n_active, CAST(max(len(embedding)) AS INT) AS dimension, count(DISTINCT len(embedding)) AS n_dimensions FROM fx_vectors WHERE status = 'active' GROUP BY ALL"),
    "v6_encode": (lambda spark, d: vectors.encode(query(spark, d, "SELECT doc_id, text FROM documents"), vectors.hashing_encoder()).select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n")), None),
    "i12_run_log": (
        i12,
        "WITH r AS (SELECT run_id % 1000 AS run_id, updated_at, latency_ms, status, run_id AS seq FROM fx_runs), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) AS n FROM r) SELECT run_id, updated_at, latency_ms, status, seq FROM k WHERE n = 1",
    ),
    "i12_upsert": (
        i12_upsert,
        "WITH r AS (SELECT run_id % 1000 AS run_id, updated_at, latency_ms, status, run_id AS seq FROM fx_runs), k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, seq DESC) AS n FROM r) SELECT run_id, updated_at, latency_ms, status, seq FROM k WHERE n = 1",
    ),
}
