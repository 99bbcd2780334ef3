"""Registered queries of filters, ranking and rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.norm import norm_weak
from folium.operators import filters as p
from folium.operators import fusion
from folium.operators import ranking as r
from folium.operators import rounds as c
from folium.plans.fixtures import query, view


def intents(spark: SparkSession, d: str) -> DataFrame:
    one = lambda x: F.array_compact(F.array(x))
    none = F.array().cast("array<string>")
    return view(spark, d, "fx_intents").select("run_id", "year_start", "year_end", one("venue_term").alias("venues"), none.alias("authors"), none.alias("institutions"), one("must_term").alias("must"), one("exclude_term").alias("exclude"), F.when(F.col("must_term") == "er", F.array(F.lit("zzq"))).otherwise(none).alias("datasets"), none.alias("methods"), one("domain").alias("domains"), "target_count")


#: Intents of many runs, drawn from orders; some break rules.
WIDE = """SELECT o_orderkey AS run_id, CAST(1990 + o_orderkey % 30 AS INT) AS year_start, CAST(2000 + o_custkey % 30 AS INT) AS year_end, concat('t', o_orderkey % 9) AS topic, concat('T', o_custkey % 9) AS task,
  concat('m', o_orderkey % 4) AS must, concat('M', o_custkey % 4) AS excluded, CAST(o_orderkey % 23 AS INT) AS target_count, CAST(o_custkey % 104 AS INT) AS source_recall,
  CASE o_orderkey % 5 WHEN 0 THEN 'Machine  Learning' WHEN 1 THEN 'public health' WHEN 2 THEN 'history' WHEN 3 THEN 'AI' ELSE 'Genetics' END AS domain FROM orders"""


def wide_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = query(spark, d, WIDE)
    none = F.array().cast("array<string>")
    when = lambda test, *v: F.when(F.expr(test), F.array(*v)).otherwise(none)
    return rows.select("run_id", "year_start", "year_end", "target_count", "source_recall", when("run_id % 7 > 0", "topic").alias("topics"), when("run_id % 3 = 0", "task").alias("tasks"), when("run_id % 4 = 1", F.lit("bert")).alias("methods"), when("run_id % 5 = 1", "topic").alias("datasets"), when("run_id % 7 > 0", "must").alias("must"), none.alias("should"), F.array("excluded").alias("exclude"), F.array("domain").alias("domains"), when("run_id % 11 = 0", F.lit("poster")).alias("paper_types"))


def results(spark: SparkSession, d: str, name: str = "fx_results") -> DataFrame:
    return view(spark, d, name).withColumn("relevance", F.col("relevance").cast("double"))


#: Page requests: some for each whole run, by the orders table.
REQUESTS = """SELECT o_orderkey AS request_id, concat('r', o_custkey % 10) AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'openalex' END AS source, CASE WHEN o_orderkey % 4 = 0 THEN 'satisfied' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 2000 END AS year_from, CASE WHEN o_orderkey % 7 = 0 THEN 2015 END AS year_to, CASE o_orderkey % 3 WHEN 0 THEN 'relevance' WHEN 1 THEN 'year_desc' ELSE 'citation_desc' END AS sort,
  CAST(1 + o_custkey % 9 AS INT) AS page, 5 AS page_size FROM orders WHERE o_orderkey % 50 = 0"""
#: The same, all of the run r0: the records of one run meet every request.
RUN_REQUESTS = REQUESTS.replace("concat('r', o_custkey % 10)", "concat('r', o_orderkey % 10)")

_MATCH = """WITH t AS (SELECT h.*, i.year_start, i.year_end, i.must_term, i.exclude_term, i.venue_term, trim(regexp_replace(replace(lower(concat(h.title, ' ', h.abstract)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS txt,
  lower(trim(coalesce(h.venue, ''))) AS vn FROM {hits} h LEFT JOIN fx_intents i ON i.run_id = h.run_id)"""
_REASON = """CASE WHEN year_start IS NOT NULL AND NOT coalesce(year BETWEEN year_start AND year_end, false) THEN 'year_range' WHEN venue_term IS NOT NULL AND vn <> '' AND NOT (contains(vn, venue_term) OR contains(venue_term, vn)) THEN 'venue'
  WHEN must_term IS NOT NULL AND NOT contains(txt, must_term) THEN 'must_include' WHEN exclude_term IS NOT NULL AND contains(txt, exclude_term) THEN 'exclude' END"""


def _assessments(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_assessments")
    return rows.select("run_id", "paper_id", F.lit(1).alias("batch"), F.lit(1).alias("item"), F.col("relevance").cast("double").alias("relevance"), "status", F.array("evidence").alias("evidence"), F.concat(F.lit("because of "), "evidence").alias("reason"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "SELECT run_id, paper_id, title, abstract, year, venue, paper_type, pair_score, semantic_score, 1.0 / (60 + raw_rank) AS rrf_score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN relevance IS NULL THEN 1 ELSE 0 END, seq) AS INT) AS position FROM fx_results")


_POSITIONS = "SELECT run_id, paper_id, title, abstract, year, venue, paper_type, pair_score, semantic_score, 1.0 / (60 + raw_rank) AS rrf_score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN relevance IS NULL THEN 1 ELSE 0 END, seq) AS INT) AS position FROM fx_results"
_R4 = f"""WITH p AS ({_POSITIONS}), s AS (SELECT * FROM p WHERE position <= 20),
  a AS (SELECT s.*, CAST(a.relevance AS DOUBLE) AS relevance, a.status, a.evidence, coalesce(trim(a.evidence) <> '' AND contains(lower(concat_ws(chr(10), s.title, s.abstract, s.year, s.venue, s.paper_type)), lower(trim(a.evidence))), false) AS proof
    FROM s LEFT JOIN fx_assessments a ON a.run_id = s.run_id AND a.paper_id = s.paper_id),
  f AS (SELECT *, CASE WHEN relevance IS NULL OR NOT proof THEN 'uncertain' WHEN relevance < 0.6 AND status = 'satisfied' THEN 'uncertain' ELSE status END AS final_status, bool_or(relevance IS NOT NULL) OVER (PARTITION BY run_id) AS has FROM a),
  g AS (SELECT f.*, has AND coalesce(relevance < 0.35 OR final_status = 'not_satisfied', false) AS gone, least(i.target_count, 20) AS target FROM f JOIN fx_intents i ON i.run_id = f.run_id),
  k AS (SELECT *, CASE WHEN has THEN row_number() OVER (PARTITION BY run_id ORDER BY relevance DESC NULLS LAST, pair_score DESC NULLS LAST, semantic_score DESC NULLS LAST, rrf_score DESC NULLS LAST, CASE WHEN final_status = 'satisfied' THEN 0 ELSE 1 END, paper_id)
    ELSE row_number() OVER (PARTITION BY run_id ORDER BY position) END AS rank FROM g WHERE NOT gone)"""


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return c.relevance_flags(results(spark, d), intents(spark, d))


_FLAGS = """fl AS (SELECT x.*, coalesce(x.status = 'satisfied', false) AS high, coalesce(x.status = 'uncertain', false) AS partial, i.must_term, i.year_start, i.year_end, i.target_count,
  replace(lower(concat_ws(chr(10), title, abstract, venue, paper_type)), 'ß', 'ss') AS txt FROM fx_results x JOIN fx_intents i ON i.run_id = x.run_id)"""
_GAPS = """gp AS (
  SELECT run_id, 'must_include' AS gap_type, must_term AS "constraint", 1.0 AS severity, 0 AS n FROM fl WHERE must_term IS NOT NULL GROUP BY run_id, must_term HAVING count_if(high AND contains(txt, must_term)) = 0 UNION ALL
  SELECT run_id, 'dataset', 'zzq', 0.9, 0 FROM fl WHERE must_term = 'er' GROUP BY run_id HAVING count_if(high AND contains(txt, 'zzq')) = 0 UNION ALL
  SELECT run_id, 'year_range', concat(year_start, '-', year_end), 0.85, 0 FROM fl GROUP BY run_id, year_start, year_end HAVING count_if(high AND coalesce(year BETWEEN year_start AND year_end, false)) = 0 UNION ALL
  SELECT run_id, 'source', source, CASE WHEN source = 'dblp' THEN 0.7 ELSE 0.45 END, 0 FROM fl GROUP BY run_id, source HAVING count_if(high) = 0 UNION ALL
  SELECT run_id, 'result_count', 'high_relevance', (target_count - count_if(high)) / target_count, count_if(high) FROM fl GROUP BY run_id, target_count HAVING count_if(high) < target_count)"""


def _source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("run_id", "source").agg(F.count_if("high").alias("n"), (F.col("source") == "dblp").alias("unavailable"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return c.coverage_gaps(_flags(spark, d), intents(spark, d), _source_counts(spark, d))


def c6(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("identity", fusion.round_identity(results(spark, d))).select("run_id", "round", "seq", "identity", "source", "title", "abstract", "venue", "paper_type", "year", "status", "relevance")
    return c.replay_rounds(rows, intents(spark, d)).withColumn("marginal_gain", F.round("marginal_gain", 8))


_C6 = """WITH h AS (SELECT *, CASE WHEN trim(doi) <> '' THEN concat('doi:', lower(trim(doi))) WHEN trim(arxiv_id) <> '' THEN concat('arxiv:', lower(trim(arxiv_id))) WHEN trim(pmid) <> '' THEN concat('pmid:', lower(trim(pmid))) WHEN trim(openalex_id) <> '' THEN concat('openalex:', lower(trim(openalex_id))) WHEN trim(semantic_scholar_id) <> '' THEN concat('semantic_scholar:', lower(trim(semantic_scholar_id))) WHEN trim(dblp_key) <> '' THEN concat('dblp:', lower(trim(dblp_key))) ELSE concat('id:', lower(trim(paper_id))) END AS ident FROM fx_results),
  o AS (SELECT *, min(round) OVER (PARTITION BY run_id, ident) AS first_round, row_number() OVER (PARTITION BY run_id, ident ORDER BY round DESC, seq DESC) AS z FROM h),
  rd AS (SELECT i.*, r.round FROM fx_intents i, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS round) r),
  s AS (SELECT rd.run_id, rd.round, o.first_round, o.year, coalesce(o.status = 'satisfied', false) AS high, coalesce(o.status = 'uncertain', false) AS partial, replace(lower(concat_ws(chr(10), o.title, o.abstract, o.venue, o.paper_type)), 'ß', 'ss') AS txt FROM o JOIN rd ON rd.run_id = o.run_id AND o.first_round <= rd.round WHERE o.z = 1),
  n AS (SELECT rd.run_id, rd.round, any_value(rd.target_count) AS t, any_value(rd.must_term) AS m, count(*) FILTER (WHERE high) AS n_high, count(*) FILTER (WHERE partial) AS n_partial, count(*) FILTER (WHERE high AND first_round = s.round) AS n_new, count(s.run_id) AS seen,
      count(*) FILTER (WHERE high AND contains(txt, rd.must_term)) AS n_must, count(*) FILTER (WHERE high AND contains(txt, 'zzq')) AS n_data, count(*) FILTER (WHERE high AND year BETWEEN rd.year_start AND rd.year_end) AS n_year
    FROM rd LEFT JOIN s ON s.run_id = rd.run_id AND s.round = rd.round GROUP BY rd.run_id, rd.round),
  z AS (SELECT rd.run_id, rd.round, count(*) AS n_zero FROM rd JOIN (SELECT DISTINCT run_id, source FROM h) q ON q.run_id = rd.run_id WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.run_id = rd.run_id AND h.round = rd.round AND h.source = q.source) GROUP BY ALL),
  g AS (SELECT n.*, CASE WHEN seen = 0 THEN 0 ELSE CAST(m IS NOT NULL AND n_must = 0 AS INT) + CAST(coalesce(m = 'er', false) AND n_data = 0 AS INT) + CAST(n_year = 0 AS INT) END AS cg, coalesce(z.n_zero, 0) AS nz FROM n LEFT JOIN z ON z.run_id = n.run_id AND z.round = n.round),
  e AS (SELECT run_id, round, n_high, n_partial, cg + nz + CAST(seen > 0 AND n_high < t AS INT) AS n_gaps, n_new, round(least(1.0, n_new / t), 8) AS marginal_gain, CASE WHEN n_high >= t AND cg = 0 THEN 'target_met' WHEN round >= 3 THEN 'max_rounds' END AS stop_reason FROM g)
  SELECT *, stop_reason IS NULL AND n_gaps > 0 AS should_continue, round <= min(CASE WHEN stop_reason IS NOT NULL THEN round END) OVER (PARTITION BY run_id) AS executed FROM e"""

_TOKENS = "list_sort(list_distinct(regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')))"
#: Counts of runs; each rule is broken by some of them.
FUNNEL = """SELECT run_id, count(*) AS normalized, count(*) - CASE WHEN run_id LIKE 'r3%' THEN 1 ELSE 0 END AS sources, count(DISTINCT coalesce(doi, paper_id)) AS deduplicated,
  count(*) - count(DISTINCT coalesce(doi, paper_id)) + CASE WHEN run_id LIKE 'r4%' THEN 1 ELSE 0 END AS merged, count_if(year IS NULL) AS filtered, count(DISTINCT coalesce(doi, paper_id)) - count_if(year IS NULL) - CASE WHEN run_id LIKE 'r5%' THEN 1 ELSE 0 END AS kept, count_if(year IS NULL AND doi IS NOT NULL) AS reasons FROM fx_hits GROUP BY run_id"""

#: User turns as a run's queries, with repeats.
TURNS = "SELECT conv_id AS run_id, CAST(turn + 1 AS BIGINT) AS pos, CASE WHEN turn % 4 = 2 THEN 'the same question of all' ELSE text END AS query FROM conversations WHERE role = 'user'"
_SIM = f"""t AS ({TURNS}), k AS (SELECT run_id, pos, query, {_TOKENS.format(x='query')} AS w FROM t),
  sim AS (SELECT a.run_id, a.pos AS a, b.pos AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM k a JOIN k b ON a.run_id = b.run_id AND a.pos > b.pos WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, TURNS)


def _gap_rows(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, d, "SELECT o_orderkey AS run_id, o_custkey AS gap, CASE o_orderkey % 4 WHEN 0 THEN 'dataset' WHEN 1 THEN 'method' WHEN 2 THEN 'source' ELSE 'must_include' END AS gap_type, concat('focus ', o_custkey % 50) AS `constraint` FROM orders")


QUERIES = {
    "p1_filter_strict": (
        lambda spark, d: p.filter_strict(view(spark, d, "fx_papers"), intents(spark, d)).select("seq"),
        _MATCH.format(hits="fx_papers") + " SELECT seq FROM t WHERE (year_start IS NULL OR coalesce(year BETWEEN year_start AND year_end, false)) AND (venue_term IS NULL OR (vn <> '' AND (contains(vn, venue_term) OR contains(venue_term, vn)))) AND (must_term IS NULL OR contains(txt, must_term)) AND (exclude_term IS NULL OR NOT contains(txt, exclude_term))",
    ),
    "p2_filter_reason": (
        lambda spark, d: p.filter_reason(view(spark, d, "fx_hits"), intents(spark, d)).select("run_id", "seq", "fail_reason"),
        _MATCH.format(hits="fx_hits") + f" SELECT run_id, seq, {_REASON} AS fail_reason FROM t",
    ),
    "p3_filter_report": (
        lambda spark, d: p.filter_report(p.filter_reason(view(spark, d, "fx_hits"), intents(spark, d)), "doi"),
        _MATCH.format(hits="fx_hits") + f""", f AS (SELECT run_id, doi, {_REASON} AS fr FROM t) SELECT run_id, count_if(fr IS NULL) AS n_kept, count_if(fr IS NOT NULL) AS n_removed, count(DISTINCT CASE WHEN fr IS NULL THEN doi END) AS n_families,
          count_if(coalesce(fr = 'year_range', false)) AS n_year_range, count_if(coalesce(fr = 'venue', false)) AS n_venue, count_if(coalesce(fr = 'author', false)) AS n_author, count_if(coalesce(fr = 'institution', false)) AS n_institution, count_if(coalesce(fr = 'must_include', false)) AS n_must_include, count_if(coalesce(fr = 'exclude', false)) AS n_exclude FROM f GROUP BY run_id""",
    ),
    "p4_filter_results": (
        lambda spark, d: p.filter_results(results(spark, d, "fx_whole_results"), query(spark, d, RUN_REQUESTS)).select("request_id", "seq"),
        f"WITH q AS ({RUN_REQUESTS}) SELECT request_id, x.seq FROM q JOIN fx_whole_results x ON x.run_id = q.run_id AND (q.source IS NULL OR x.source = q.source) AND (q.status IS NULL OR x.status = q.status) AND (q.year_from IS NULL OR x.year >= q.year_from) AND (q.year_to IS NULL OR x.year <= q.year_to)",
    ),
    "p6_validate_evidence": (
        lambda spark, d: p.validate_evidence(query(spark, d, "SELECT 'all' AS run_id, doc_id AS paper_id, text AS abstract FROM documents"), query(spark, d, "SELECT 'all' AS run_id, d.doc_id AS paper_id, array(upper(b.text), b.text, 'no such passage') AS evidence, b.item_id FROM benchmark b JOIN (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item FROM documents) d ON d.item = b.item_id")).select("paper_id", "item_id", F.size("valid_evidence").alias("n")),
        "SELECT d.doc_id AS paper_id, b.item_id, CASE WHEN contains(lower(d.text), lower(trim(b.text))) THEN CASE WHEN upper(trim(b.text)) = trim(b.text) THEN 1 ELSE 2 END ELSE 0 END AS n FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id",
    ),
    "p7_invalid_intents": (
        lambda spark, d: p.invalid_intents(wide_intents(spark, d)).withColumn("errors", F.array_join("errors", ",")),
        f"""WITH w AS ({WIDE}), e AS (SELECT run_id, concat_ws(',', CASE WHEN year_start > year_end THEN 'year_order' END, CASE WHEN run_id % 7 > 0 AND lower(must) = lower(excluded) THEN 'must_excluded' END, CASE WHEN target_count NOT BETWEEN 1 AND 20 THEN 'target_range' END,
          CASE WHEN source_recall < target_count OR source_recall > 100 THEN 'recall_range' END, CASE WHEN run_id % 7 = 0 AND run_id % 4 <> 1 AND run_id % 5 <> 1 THEN 'no_terms' END, CASE WHEN run_id % 11 = 0 THEN 'paper_type' END) AS errors FROM w) SELECT * FROM e WHERE errors <> ''""",
    ),
    "q1_audit": (
        lambda spark, d: p.audit(view(spark, d, "fx_hits").withColumns({"year": F.expr("CASE WHEN seq % 50 = 0 THEN 1500 ELSE year END"), "citation_count": F.expr("citation_count - 5")}), p.paper_rules(), ["seq"]),
        "SELECT seq, rule FROM (SELECT seq, unnest([CASE WHEN seq % 50 = 0 THEN 'year_range' END, CASE WHEN citation_count < 5 THEN 'citations_negative' END, CASE WHEN trim(title) = '' THEN 'title_blank' END]) AS rule FROM fx_hits) q WHERE rule IS NOT NULL",
    ),
    "q2_audit_funnel": (
        lambda spark, d: p.audit_funnel(query(spark, d, FUNNEL)),
        f"WITH n AS ({FUNNEL}) SELECT run_id, sources = normalized AS sources_ok, normalized - merged = deduplicated AS merged_ok, deduplicated - kept = filtered AS kept_ok, reasons = filtered AS reasons_ok FROM n",
    ),
    "r1_rank_semantic": (
        lambda spark, d: r.rank_semantic(query(spark, d, "SELECT concat('r', vec_id % 10, '-', CAST(floor(vec_id / 1000.0) AS BIGINT)) AS run_id, paper_id, 1.0 / (60 + vec_id % 7) AS rrf_score FROM fx_vectors"), view(spark, d, "fx_vectors"), query(spark, d, "SELECT concat('r', vec_id % 10, '-', CAST(floor(vec_id / 10.0) AS BIGINT)) AS run_id, embedding FROM fx_vectors")).select("run_id", "paper_id", "semantic_score", "rank"),
        "WITH q AS (SELECT concat('r', vec_id % 10, '-', CAST(floor(vec_id / 10.0) AS BIGINT)) AS run_id, CAST(embedding AS DOUBLE[]) AS e FROM fx_vectors), s AS (SELECT q.run_id, v.paper_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), q.e), 10) AS semantic_score, 1.0 / (60 + v.vec_id % 7) AS rrf FROM fx_vectors v JOIN q ON q.run_id = concat('r', v.vec_id % 10, '-', CAST(floor(v.vec_id / 1000.0) AS BIGINT))), k AS (SELECT run_id, paper_id, semantic_score, row_number() OVER (PARTITION BY run_id ORDER BY semantic_score DESC, rrf DESC, paper_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 60",
    ),
    "r2_rank_rrf": (
        lambda spark, d: r.rank_rrf(_positions(spark, d)).select("run_id", "paper_id", "rank", "ranking_note"),
        f"WITH p AS ({_POSITIONS}), k AS (SELECT run_id, paper_id, row_number() OVER (PARTITION BY run_id ORDER BY rrf_score DESC, paper_id) AS rank, 'vectors unavailable' AS ranking_note FROM p) SELECT * FROM k WHERE rank <= 60",
    ),
    "r3_rank_pair": (
        lambda spark, d: r.rank_pair(_positions(spark, d)).select("run_id", "paper_id", "rank"),
        f"WITH p AS ({_POSITIONS}), k AS (SELECT run_id, paper_id, row_number() OVER (PARTITION BY run_id ORDER BY pair_score DESC NULLS LAST, semantic_score DESC NULLS LAST, rrf_score DESC, paper_id) AS rank FROM p) SELECT * FROM k WHERE rank <= 24",
    ),
    "r4_rank_assessed": (
        lambda spark, d: r.rank_assessed(_positions(spark, d), _assessments(spark, d), intents(spark, d))[0].select("run_id", "paper_id", "rank", "final_status", "recommendation"),
        _R4 + " SELECT run_id, paper_id, rank, final_status, CASE WHEN proof THEN concat('because of ', evidence) END AS recommendation FROM k WHERE rank <= target",
    ),
    "r4_assessed_counts": (
        lambda spark, d: r.rank_assessed(_positions(spark, d), _assessments(spark, d), intents(spark, d))[1],
        _R4 + " SELECT g.run_id, count_if(gone) AS n_rejected, greatest(count_if(NOT gone) - max(target), 0) + (SELECT greatest(count(*) - 20, 0) FROM p WHERE p.run_id = g.run_id) AS n_truncated FROM g GROUP BY g.run_id",
    ),
    "j5_join_assessments": (
        lambda spark, d: r.join_assessments(results(spark, d).select("run_id", "paper_id"), _assessments(spark, d).unionByName(_assessments(spark, d).withColumns({"batch": F.lit(2), "relevance": F.lit(0.0)}))).select("run_id", "paper_id", "relevance", "reason"),
        "SELECT x.run_id, x.paper_id, CAST(a.relevance AS DOUBLE) AS relevance, CASE WHEN a.paper_id IS NOT NULL THEN concat('because of ', a.evidence) END AS reason FROM fx_results x LEFT JOIN fx_assessments a ON a.run_id = x.run_id AND a.paper_id = x.paper_id",
    ),
    "r5_batch_status": (
        lambda spark, d: r.batch_status(_positions(spark, d), query(spark, d, "SELECT run_id, CAST(round AS INT) AS batch, max(seq) % 2 = 0 AS ok FROM fx_hits GROUP BY run_id, round")).select("run_id", "paper_id", "batch", "failed", "fallback"),
        f"WITH p AS ({_POSITIONS}), c AS (SELECT run_id, round AS batch, max(seq) % 2 = 0 AS ok FROM fx_hits GROUP BY run_id, round), j AS (SELECT p.run_id, paper_id, CAST(floor((position - 1) / 10) AS INT) + 1 AS batch FROM p), k AS (SELECT j.*, NOT coalesce(ok, false) AS failed FROM j LEFT JOIN c ON c.run_id = j.run_id AND c.batch = j.batch) SELECT *, bool_and(failed) OVER (PARTITION BY run_id) AS fallback FROM k",
    ),
    "r7_page_results": (
        lambda spark, d: r.page_results(results(spark, d, "fx_whole_results").withColumn("rrf_score", 1.0 / (60 + F.col("raw_rank"))), query(spark, d, REQUESTS), "run_id").select("request_id", "paper_id", "at", "total", "shown_page"),
        f"""WITH q AS ({REQUESTS}), x AS (SELECT q.request_id, q.sort, q.page, q.page_size, h.*, 1.0 / (60 + raw_rank) AS rrf FROM q JOIN fx_whole_results h ON h.run_id = q.run_id),
        k AS (SELECT request_id, paper_id, page, page_size, count(*) OVER (PARTITION BY request_id) AS total, CASE sort
          WHEN 'relevance' THEN row_number() OVER (PARTITION BY request_id ORDER BY relevance DESC NULLS LAST, pair_score DESC NULLS LAST, semantic_score DESC NULLS LAST, rrf DESC NULLS LAST, CASE WHEN status = 'satisfied' THEN 0 ELSE 1 END, paper_id)
          WHEN 'year_desc' THEN row_number() OVER (PARTITION BY request_id ORDER BY year DESC NULLS LAST, paper_id DESC) ELSE row_number() OVER (PARTITION BY request_id ORDER BY citation_count DESC, coalesce(year, 0) DESC, paper_id DESC) END AS "at" FROM x),
        z AS (SELECT *, least(page, greatest(CAST(ceil(total / page_size) AS BIGINT), 1)) AS shown_page FROM k) SELECT request_id, paper_id, "at", total, shown_page FROM z WHERE "at" > (shown_page - 1) * page_size AND "at" <= shown_page * page_size""",
    ),
    "r9_vector_search": (
        lambda spark, d: r.vector_search(query(spark, d, "SELECT vec_id AS query_id, embedding FROM fx_vectors WHERE vec_id % 50 = 0"), view(spark, d, "fx_vectors"), 20),
        "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.status, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 10) AS score FROM fx_vectors v JOIN fx_vectors q ON q.vec_id % 50 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s), k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM o WHERE n <= 100 AND status = 'active') SELECT * FROM k WHERE rank <= 20",
    ),
    "r9_shortfalls": (
        lambda spark, d: (lambda q: r.shortfalls(q, r.vector_search(q, view(spark, d, "fx_vectors"), 20, over=1), 20))(query(spark, d, "SELECT vec_id AS query_id, embedding FROM fx_vectors WHERE vec_id % 50 = 0")),
        "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.status, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 10) AS score FROM fx_vectors v JOIN fx_vectors q ON q.vec_id % 50 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, 20 - count_if(status = 'active') AS missing FROM o WHERE n <= 20 GROUP BY query_id HAVING count_if(status = 'active') < 20",
    ),
    "r10_term_search": (
        lambda spark, d: r.term_search(query(spark, d, "SELECT concat(conv_id, '-', turn) AS query_id, text FROM conversations WHERE role = 'user' AND conv_id % 50 = 0"), query(spark, d, "SELECT doc_id AS id, text FROM documents").select("id", norm_weak("text").alias("search_text"))).withColumn("score", F.round("score", 8)),
        """WITH q AS (SELECT concat(conv_id, '-', turn) AS query_id, list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)) AS ts FROM conversations WHERE role = 'user' AND conv_id % 50 = 0),
        t AS (SELECT query_id, len(ts) AS n, unnest(ts) AS term FROM q), c AS (SELECT doc_id AS id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS x FROM documents),
        u AS (SELECT term, c.id FROM (SELECT DISTINCT term FROM t) w JOIN c ON contains(c.x, w.term)), s AS (SELECT query_id, u.id, round(count(*) / max(n), 8) AS score FROM t JOIN u ON u.term = t.term GROUP BY query_id, u.id),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM k WHERE rank <= 10""",
    ),
    "c1_relevance_flags": (lambda spark, d: _flags(spark, d).select("seq", "high", "partial"), f"WITH {_FLAGS} SELECT seq, high, partial FROM fl"),
    "c2_match_counts": (
        lambda spark, d: c.match_counts(_flags(spark, d), intents(spark, d), "must"),
        f"""WITH {_FLAGS} SELECT i.run_id, i.must_term AS "constraint", count(fl.run_id) AS n FROM fx_intents i LEFT JOIN fl ON fl.run_id = i.run_id AND fl.high AND contains(fl.txt, i.must_term) WHERE i.must_term IS NOT NULL GROUP BY ALL""",
    ),
    "c3_coverage_gaps": (
        lambda spark, d: _gaps(spark, d).withColumn("severity", F.round("severity", 8)),
        f"""WITH {_FLAGS}, {_GAPS} SELECT run_id, gap_type, "constraint", round(CAST(severity AS DOUBLE), 8) AS severity, n, row_number() OVER (PARTITION BY run_id ORDER BY CAST(severity AS DOUBLE) DESC, gap_type, "constraint") AS position FROM gp""",
    ),
    "c6_replay_rounds": (c6, _C6),
    "c7_route_plan": (
        lambda spark, d: c.route_plan(wide_intents(spark, d)).withColumn("candidates", F.array_join("candidates", ",")),
        f"""WITH w AS ({WIDE}), k AS (SELECT run_id, ['openalex', 'semantic_scholar'] || CASE WHEN domain IN ('Machine  Learning', 'AI') THEN ['arxiv', 'dblp'] WHEN domain IN ('public health', 'Genetics') THEN ['pubmed'] ELSE [] END AS cs FROM w)
        SELECT run_id, round, array_to_string(cs, ',') AS candidates, cs[least(round, len(cs))] AS source FROM k, (SELECT CAST(unnest([1, 2, 3]) AS INT) AS round) r""",
    ),
    "c8_propose_queries": (
        lambda spark, d: c.propose_queries(_gap_rows(spark, d), wide_intents(spark, d)),
        f"""WITH w AS ({WIDE}), g AS (SELECT o_orderkey AS run_id, o_custkey AS gap, o_orderkey % 4 AS k, concat('focus ', o_custkey % 50) AS f FROM orders WHERE o_orderkey % 4 <> 2),
        l AS (SELECT g.*, CASE WHEN w.run_id % 7 > 0 THEN topic END AS topic, CASE WHEN w.run_id % 3 = 0 THEN task END AS task, CASE WHEN w.run_id % 4 = 1 THEN 'bert' END AS method, CASE WHEN w.run_id % 5 = 1 THEN topic END AS data FROM g JOIN w ON w.run_id = g.run_id),
        v AS (SELECT run_id, gap, 0 AS pos, [topic, task, method, data, f] AS ts FROM l UNION ALL SELECT run_id, gap, 1, CASE WHEN k = 0 THEN [f, task, topic] ELSE [f, data, task, topic] END FROM l),
        x AS (SELECT run_id, gap, pos, list_filter(ts, lambda t: t IS NOT NULL) AS ts FROM v), y AS (SELECT run_id, gap, pos, list_filter(ts, lambda t, i: list_position(list_transform(ts, lambda u: lower(u)), lower(t)) = i) AS ts FROM x),
        z AS (SELECT run_id, gap, pos, array_to_string(ts, ' ') AS query FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, gap, {_TOKENS.format(x='query')} ORDER BY pos) AS n FROM z) SELECT run_id, gap, pos, query FROM r WHERE n = 1""",
    ),
    "c9_query_fingerprint": (
        lambda spark, d: query(spark, d, "SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", c.query_fingerprint("text").alias("f")),
        f"SELECT conv_id, turn, sha256(array_to_string({_TOKENS.format(x='text')}, ' ')) AS f FROM conversations",
    ),
    "j8_similar_queries": (lambda spark, d: c.similar_queries(_turns(spark, d)).withColumn("similarity", F.round("similarity", 8)), f"WITH {_SIM} SELECT run_id, a, b, round(similarity, 8) AS similarity FROM sim"),
    "j8_similar_classes": (
        lambda spark, d: c.class_links(*c.similar_classes(_turns(spark, d))),
        f"""WITH {_SIM}, cl AS (SELECT run_id, pos, CASE WHEN len(w) = 0 THEN pos ELSE min(pos) OVER (PARTITION BY run_id, list_sort(w)) END AS class FROM k),
        li AS (SELECT DISTINCT x.run_id, x.class AS a, y.class AS b FROM sim JOIN cl x ON x.run_id = sim.run_id AND x.pos = sim.a JOIN cl y ON y.run_id = sim.run_id AND y.pos = sim.b WHERE x.class <> y.class),
        bi AS (SELECT run_id, a AS class, b AS other FROM li UNION SELECT run_id, b, a FROM li), cn AS (SELECT run_id, class, count(*) AS n_links FROM bi GROUP BY ALL)
        SELECT cl.run_id, cl.pos, cl.class, coalesce(n_links, 0) AS n_links FROM cl LEFT JOIN cn ON cn.run_id = cl.run_id AND cn.class = cl.class""",
    ),
    "c10_accept_queries": (
        lambda spark, d: c.accept_queries(_turns(spark, d).withColumn("gap", F.floor(F.col("pos") / 5)), _turns(spark, d).where("run_id % 4 = 0 and pos = 1").select("run_id", "query"), 1).select("run_id", "gap", "pos", "accepted"),
        f"""WITH RECURSIVE {_SIM}, c AS (SELECT k.run_id, k.pos, CAST(floor(k.pos / 5) AS BIGINT) AS gap, row_number() OVER (PARTITION BY k.run_id ORDER BY k.pos) AS rn, len(k.w) = 0 OR (k.run_id % 4 = 0 AND (k.pos = 1 OR EXISTS (SELECT 1 FROM sim WHERE sim.run_id = k.run_id AND sim.a = k.pos AND sim.b = 1))) AS bad,
          (SELECT coalesce(list(sim.b), []) FROM sim WHERE sim.run_id = k.run_id AND sim.a = k.pos) AS bs FROM k),
        g(run_id, rn, gap, pos, n, acc, accepted) AS (SELECT run_id, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[], false FROM (SELECT DISTINCT run_id FROM c) q UNION ALL
          SELECT s.run_id, s.rn, s.gap, s.pos, s.n + s.ok::BIGINT, CASE WHEN s.ok THEN list_append(s.acc, s.pos) ELSE s.acc END, s.ok FROM (SELECT c.run_id, c.rn, c.gap, c.pos, CASE WHEN c.gap = g.gap THEN g.n ELSE 0 END AS n, g.acc, NOT c.bad AND NOT list_has_any(g.acc, c.bs) AND (c.gap <> g.gap OR g.n < 1) AS ok FROM g JOIN c ON c.run_id = g.run_id AND c.rn = g.rn + 1) s)
        SELECT run_id, gap, pos, accepted FROM g WHERE rn > 0""",
    ),
    "c10_evolution_report": (
        lambda spark, d: (lambda t: c.evolution_report(_gap_rows(spark, d), c.accept_queries(t.select("run_id", "gap", "pos", "query"), query(spark, d, "SELECT o_orderkey AS run_id, concat('t', o_orderkey % 9) AS query FROM orders"))))(query(spark, d, "SELECT o_orderkey AS run_id, o_custkey AS gap, CAST(1 AS BIGINT) AS pos, CASE WHEN o_custkey % 3 = 0 THEN concat('T', o_orderkey % 9) ELSE concat('own words ', o_custkey) END AS query FROM orders WHERE o_orderkey % 4 <> 2")).withColumn("warnings", F.array_join("warnings", "|")),
        """WITH g AS (SELECT o_orderkey AS run_id, o_orderkey % 4 = 2 AS other, o_orderkey % 4 <> 2 AND o_custkey % 3 <> 0 AS asked, concat('focus ', o_custkey % 50) AS f FROM orders)
        SELECT run_id, CAST(asked AS BIGINT) AS n_generated, CAST(NOT asked AS BIGINT) AS n_skipped, CASE WHEN other THEN concat(f, ': left to the controller') WHEN NOT asked THEN concat(f, ': no new query') ELSE '' END AS warnings FROM g""",
    ),
    "c11_gate_proposals": (
        lambda spark, d: c.gate_proposals(_turns(spark, d).select("run_id", ((F.col("pos") + 1) / 2).cast("int").alias("pos"), "query", F.when(F.col("run_id") % 3 == 0, "de").otherwise("en").alias("language")), _turns(spark, d), _turns(spark, d).where("pos = 1 and run_id % 2 = 0").select("run_id", "query")),
        f"""WITH {_SIM}, v AS (SELECT * FROM k WHERE pos <= 4 AND run_id % 3 <> 0 AND length(trim(query)) BETWEEN 1 AND 300 AND len(w) > 0),
        x AS (SELECT v.run_id, v.pos, EXISTS (SELECT 1 FROM k JOIN sim ON sim.run_id = k.run_id AND sim.a = v.pos AND sim.b = k.pos WHERE k.run_id = v.run_id AND k.pos = 1) AS near FROM v),
        good AS (SELECT v.run_id, CAST((v.pos + 1) // 2 AS BIGINT) AS pos, query, 'model' AS origin FROM v JOIN x ON x.run_id = v.run_id AND x.pos = v.pos WHERE CASE WHEN v.run_id % 2 = 0 THEN v.pos > 1 AND NOT near ELSE v.pos = 1 OR NOT near OR NOT EXISTS (SELECT 1 FROM v u WHERE u.run_id = v.run_id AND u.pos = 1) END)
        SELECT * FROM good UNION ALL SELECT t.run_id, t.pos, t.query, 'rules' FROM t WHERE NOT EXISTS (SELECT 1 FROM good WHERE good.run_id = t.run_id)""",
    ),
    "c12_pending_queue": (
        lambda spark, d: c.pending_queue(_turns(spark, d).where("pos <= 5"), _turns(spark, d).where("pos > 3").withColumn("query", F.replace("query", F.lit("e"), F.lit("E"))), _turns(spark, d).where("pos = 1").select("run_id", "query")),
        f"""WITH t AS ({TURNS}), a AS (SELECT run_id, 1 AS o, pos, query FROM t WHERE pos <= 5 UNION ALL SELECT run_id, 0, pos, replace(query, 'e', 'E') FROM t WHERE pos > 3), k AS (SELECT *, replace(lower(trim(query)), 'ß', 'ss') AS key FROM a),
        x AS (SELECT k.*, row_number() OVER (PARTITION BY run_id, key ORDER BY o, pos) AS r FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = k.run_id AND t.pos = 1 AND replace(lower(trim(t.query)), 'ß', 'ss') = k.key))
        SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o, pos) AS INT) AS position, query FROM x WHERE r = 1""",
    ),
}
