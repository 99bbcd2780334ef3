"""Registered queries of the streams' batch twins and of incremental intake, and of what earlier parts left, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators import ranking, rounds
from folium.plans import search as ps
from folium.plans import sql as s
from folium.plans import state as pt
from folium.plans.fixtures import query, view
from folium.sources.store import scratch
from folium.streaming import streams as st

EVENTS = "SELECT user_id AS run_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS event_type, value FROM events"
_LAST = f"e AS ({EVENTS}), l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM e)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, EVENTS)


#: Requests with null parameters, values that differ by white space or case only, and some without a source.
_REQUESTS = """SELECT event_id AS id, CASE WHEN event_id % 13 > 0 THEN event_type END AS operation, CASE WHEN user_id % 7 > 0 THEN CAST(user_id % 10 AS STRING) END AS query,
  CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'DE' WHEN 2 THEN 'de ' END AS lang, CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP))) AS BIGINT) AS t FROM events"""


def s4(spark: SparkSession, d: str) -> DataFrame:
    rows = query(spark, d, _REQUESTS)
    return st.cache_hits(rows.select(st.cache_key(F.lit("openalex"), "operation", {"query": F.col("query"), "lang": F.col("lang")}).alias("key"), "t", "id")).select("id", "hit")


def s5(spark: SparkSession, d: str) -> DataFrame:
    """fx_hits in three batches, out of order."""
    state = st.FusionState(spark, scratch(spark, "intake"))
    hits = view(spark, d, "fx_hits")
    for i, part in enumerate((2, 0, 1)):
        state.update(hits.where(F.col("seq") % 3 == part), i)
    return state.labels()


def _cascade(spark: SparkSession, d: str):
    papers = query(spark, d, "SELECT run_id, paper_id, title, abstract, year, venue, paper_type, 1.0 / (60 + raw_rank) AS rrf_score, seq FROM fx_hits WHERE seq < (SELECT max(vec_id) FROM fx_vectors)")
    vectors = view(spark, d, "fx_vectors")
    queries = query(spark, d, "SELECT concat('r', vec_id % 10, '-', CAST(floor(vec_id / 10.0) AS BIGINT)) AS run_id, embedding FROM fx_vectors")
    scores = query(spark, d, "SELECT run_id, paper_id, pair_score FROM fx_results WHERE seq % 4 <> 0")
    return ranking.finalize(papers, vectors, queries, scores, ps._assessments(spark, d), ps.intents(spark, d))


def c5(spark: SparkSession, d: str) -> DataFrame:
    rows = query(spark, d, "SELECT o_orderkey AS run_id, o_custkey % 12 AS n_high, 1 + o_orderkey % 10 AS target_count, o_orderkey % 3 AS n_constraint_gaps, o_custkey % 17 = 0 AS budget_exhausted, CAST(1 + o_orderkey % 4 AS INT) AS round, 5 AS max_rounds, o_custkey % 5 <> 0 AS has_query, o_orderkey % 3 AS n_sources, o_custkey % 4 AS n_unavailable, o_custkey % 3 AS n_new, 1 AS minimum_new FROM orders")
    return rows.select("run_id", rounds.stop_reason().alias("stop_reason"))


_R6 = f"""WITH p AS (SELECT run_id, paper_id, title, abstract, year, venue, paper_type, 1.0 / (60 + raw_rank) AS rrf_score, seq FROM fx_hits WHERE seq < (SELECT max(vec_id) FROM fx_vectors)),
        q AS (SELECT concat('r', vec_id % 10, '-', CAST(floor(vec_id / 10.0) AS BIGINT)) AS run_id, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors),
        s1 AS (SELECT p.*, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), q.e), 10) AS semantic_score FROM p JOIN fx_vectors v ON v.paper_id = p.paper_id JOIN q ON q.run_id = p.run_id),
        t1 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY semantic_score DESC, rrf_score DESC, paper_id) AS n1 FROM s1),
        s2 AS (SELECT t1.*, f.pair_score FROM t1 LEFT JOIN fx_results f ON f.run_id = t1.run_id AND f.paper_id = t1.paper_id AND f.seq % 4 <> 0 WHERE n1 <= 60),
        t2 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pair_score DESC NULLS LAST, semantic_score DESC, rrf_score DESC, paper_id) AS position FROM s2),
        {ps._R4.replace('WITH p AS (' + ps._POSITIONS + '), s AS (SELECT * FROM p WHERE position <= 20)', 's AS (SELECT * FROM t2 WHERE position <= 20)')}"""

QUERIES = {
    "s1_latest_progress": (lambda spark, d: st.latest_progress(events(spark, d)), f"WITH {_LAST} SELECT run_id, event_type, value, ts, n, event_type IN ('completed', 'failed') AS terminal FROM l WHERE r = 1"),
    "s2_bounded_feed": (lambda spark, d: st.bounded_feed(events(spark, d), 20).select("run_id", "seq", "age"), f"WITH {_LAST} SELECT run_id, seq, r AS age FROM l WHERE r <= 20"),
    "s3_stalled_runs": (
        lambda spark, d: st.stalled_runs(events(spark, d), 3600).select("run_id", "event_type", "status"),
        f"WITH {_LAST} SELECT run_id, event_type, 'failed' AS status FROM l WHERE r = 1 AND event_type NOT IN ('completed', 'failed') AND floor(epoch((SELECT max(ts) FROM e))) - floor(epoch(ts)) > 3600",
    ),
    "s4_cache_hits": (
        s4,
        """WITH RECURSIVE e AS (SELECT event_id AS id, CASE WHEN event_id % 13 > 0 THEN concat(event_type, '|', CASE WHEN user_id % 7 > 0 THEN concat('=', user_id % 10) ELSE '-' END, '|', CASE user_id % 4 WHEN 0 THEN '=de' WHEN 1 THEN '=DE' WHEN 2 THEN '=de ' ELSE '-' END) END AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
        d AS (SELECT DISTINCT key, t FROM e WHERE key IS NOT NULL), nx AS (SELECT a.key, a.t, min(b.t) AS nt FROM d a JOIN d b ON b.key = a.key AND b.t >= a.t + 14400 GROUP BY ALL),
        m(key, t) AS (SELECT key, min(t) FROM d GROUP BY key UNION SELECT nx.key, nx.nt FROM m JOIN nx ON nx.key = m.key AND nx.t = m.t)
        SELECT id, e.key IS NOT NULL AND (m.t IS NULL OR row_number() OVER (PARTITION BY e.key, e.t ORDER BY id) > 1) AS hit FROM e LEFT JOIN m ON m.key = e.key AND m.t = e.t""",
    ),
    "s5_incremental_groups": (s5, f"WITH RECURSIVE {s.GROUPS} SELECT run_id, seq, component FROM m"),
    "r6_cascade": (
        lambda spark, d: _cascade(spark, d)[0].select("run_id", "paper_id", "rank", "final_status"),
        f"""{_R6} SELECT run_id, paper_id, rank, final_status FROM k WHERE rank <= target""",
    ),
    "r6_cascade_counts": (
        lambda spark, d: _cascade(spark, d)[1],
        f"""{_R6}, a0 AS (SELECT run_id, count(*) AS n_candidates FROM p GROUP BY run_id), a1 AS (SELECT run_id, count(*) AS n_semantic, count_if(position <= 24) AS n_pair FROM t2 GROUP BY run_id),
        a2 AS (SELECT run_id, count_if(gone) AS n_rejected, greatest(count_if(NOT gone) - max(target), 0) AS cut FROM g GROUP BY run_id), a3 AS (SELECT run_id, count(*) AS n_final FROM k WHERE rank <= target GROUP BY run_id)
        SELECT a0.run_id, n_candidates, coalesce(n_semantic, 0) AS n_semantic, coalesce(n_pair, 0) AS n_pair, coalesce(n_final, 0) AS n_final, coalesce(n_rejected, 0) AS n_rejected, coalesce(cut + greatest(n_pair - 20, 0), 0) AS n_truncated, false AS fallback
        FROM a0 LEFT JOIN a1 ON a1.run_id = a0.run_id LEFT JOIN a2 ON a2.run_id = a0.run_id LEFT JOIN a3 ON a3.run_id = a0.run_id""",
    ),
    "r8_sort_library": (
        lambda spark, d: ranking.sort_library(pt.library(spark, d), "year_asc").select("item_key", "year"),
        f"WITH {pt._FOLD} SELECT item_key, year FROM lb ORDER BY year ASC NULLS LAST, updated_at, item_key",
    ),
    "c5_stop_reason": (
        c5,
        """WITH r AS (SELECT o_orderkey AS run_id, o_custkey % 12 AS h, 1 + o_orderkey % 10 AS t, o_orderkey % 3 AS g, o_custkey % 17 = 0 AS b, 1 + o_orderkey % 4 AS rd, o_custkey % 5 <> 0 AS q, o_orderkey % 3 AS ns, o_custkey % 4 AS nu, o_custkey % 3 AS nn FROM orders)
        SELECT run_id, CASE WHEN h >= t AND g = 0 THEN 'target_met' WHEN b THEN 'budget' WHEN rd >= 5 THEN 'max_rounds' WHEN NOT q THEN 'no_query' WHEN ns > 0 AND nu > 0 AND nu >= ns THEN 'sources_down' WHEN rd > 1 AND rd < 4 AND nn < 1 THEN 'few_new' END AS stop_reason FROM r""",
    ),
    "c4_coverage_report": (
        lambda spark, d: rounds.coverage_report(ps._flags(spark, d).withColumn("round", F.lit(1)), ps._gaps(spark, d).withColumn("round", F.lit(1)), query(spark, d, "SELECT h.run_id, 1 AS round, i.target_count, count(*) AS n_new, false AS budget_exhausted, 3 AS max_rounds, true AS has_query, 0 AS n_sources, 0 AS n_unavailable, 1 AS minimum_new FROM fx_hits h JOIN fx_intents i ON i.run_id = h.run_id WHERE h.citation_count < 25 GROUP BY h.run_id, i.target_count")).select("run_id", "n_high", "n_partial", "n_gaps", F.round("marginal_gain", 8).alias("marginal_gain"), "stop_reason", "should_continue"),
        f"""WITH {ps._FLAGS}, {ps._GAPS}, n AS (SELECT h.run_id, i.target_count AS t, count(*) AS n_new FROM fx_hits h JOIN fx_intents i ON i.run_id = h.run_id WHERE h.citation_count < 25 GROUP BY h.run_id, i.target_count),
        a AS (SELECT run_id, count_if(high) AS n_high, count_if(partial) AS n_partial FROM fl GROUP BY run_id), b AS (SELECT run_id, count(*) AS n_gaps, count_if(gap_type IN ('must_include', 'dataset', 'method', 'year_range')) AS cg FROM gp GROUP BY run_id)
        SELECT n.run_id, n_high, n_partial, coalesce(n_gaps, 0) AS n_gaps, round(least(1.0, n_new / t), 8) AS marginal_gain, CASE WHEN n_high >= t AND coalesce(cg, 0) = 0 THEN 'target_met' END AS stop_reason, NOT (n_high >= t AND coalesce(cg, 0) = 0) AND coalesce(n_gaps, 0) > 0 AS should_continue FROM n JOIN a ON a.run_id = n.run_id LEFT JOIN b ON b.run_id = n.run_id""",
    ),
}
