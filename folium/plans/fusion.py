"""Registered queries of identity resolution and fusion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import norm
from folium.operators import fusion as f
from folium.plans import sql as s
from folium.plans.fixtures import query, view, whole
from folium.sources.store import saved

_groups: dict[tuple[str, str, str], DataFrame] = {}


def groups(spark: SparkSession, sf_dir: str, name: str = "fx_hits") -> DataFrame:
    """Hits with component; the narrow group table is settled once for a session, an input and a view."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    hits = view(spark, sf_dir, name)
    if at not in _groups:
        _groups[at] = saved(f.identity_groups(hits), "groups")
    return f.grouped(hits, _groups[at])


def families(spark: SparkSession, sf_dir: str, name: str = "fx_hits") -> DataFrame:
    return f.work_family(groups(spark, sf_dir, name))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 and F8 in one row for each record, with the canonical record's first author."""
    rows = groups(spark, sf_dir)
    author = rows.join(f.canonical(rows), ["run_id", "component", "seq"]).select("run_id", "component", "first_author")
    return f.fuse_fields(rows).join(f.work_family(rows), ["run_id", "component"]).join(author, ["run_id", "component"])


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.rrf(f.provenance(groups(spark, sf_dir))).withColumn("rrf_score", F.round("rrf_score", 10))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = groups(spark, sf_dir).select("run_id", "seq", "component")
    return view(spark, sf_dir, "fx_keywords").join(rows, ["run_id", "seq"]).withColumnRenamed("keyword", "term")


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first author and, for every third record, a second one; ORCIDs and institutions for some."""
    rows = groups(spark, sf_dir, "fx_whole_hits").select("run_id", "component", "seq", "source", "first_author")
    one = rows.select("run_id", "component", "seq", F.lit(1).alias("pos"), F.col("first_author").alias("name"), F.expr("CASE WHEN seq % 4 = 0 THEN concat('0000-', seq % 7) END").alias("orcid"), F.expr("CASE WHEN seq % 3 = 0 THEN concat('Inst ', seq % 5) END").alias("institution"), "source", F.expr("concat(source, '-', seq % 11)").alias("source_author_id"))
    two = rows.where("seq % 3 = 0").select("run_id", "component", "seq", F.lit(2).alias("pos"), F.expr("concat('AUTHOR  ', seq % 13)").alias("name"), F.lit(None).cast("string").alias("orcid"), F.lit(None).cast("string").alias("institution"), "source", F.lit(None).cast("string").alias("source_author_id"))
    return one.unionByName(two)


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f.merge_authors(_authors(spark, sf_dir))
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("source_author_ids")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("run_id", "component", "position", "name", "orcid", "institution", F.coalesce(ids, F.lit("")).alias("ids"))


def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of each run on its own."""
    return f.dedup_first(view(spark, sf_dir, "fx_papers"), ["run_id", "source"]).select("run_id", "source", "seq")


def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = query(spark, sf_dir, "SELECT run_id, round, count(*) AS normalized, count_if(year IS NULL) AS filtered, count(DISTINCT coalesce(doi, paper_id)) - count_if(year IS NULL) AS kept, max(CASE WHEN seq % 17 = 0 THEN concat('e', seq) END) AS error FROM fx_hits GROUP BY run_id, round")
    by_source = query(spark, sf_dir, "SELECT run_id, round, source, min(seq) AS at, count_if(year IS NULL) AS n, max(CASE WHEN seq % 17 = 0 THEN concat('e', seq) END) AS e FROM fx_hits GROUP BY run_id, round, source")
    entries = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("source", value)))))
    lists = by_source.groupBy("run_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("routes"), entries(F.col("n")).alias("reasons"), entries(F.col("e")).alias("errors"))
    out = f.aggregate_rounds(rounds.join(lists, ["run_id", "round"]))
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({"routes": F.array_join("routes", ","), "reasons": shown("reasons"), "errors": F.coalesce(shown("errors"), F.lit(""))})


def _fused_before(spark: SparkSession, d: str) -> DataFrame:
    """fx_hits of which every fourth names another record's own id, and one without id, among those it came from."""
    hits = view(spark, d, "fx_hits")
    record = lambda source, external: F.struct(source.alias("source"), external.alias("external_id"))
    other = F.concat(F.lit(" DOC:"), (F.col("seq") + 5).cast("string"))
    return hits.withColumn("source_records", F.when(F.col("seq") % 4 == 0, F.array(record(F.col("source"), other), record(F.lit("dblp"), F.lit("  ")), record(F.lit(None).cast("string"), F.lit("x")))))


_PROVENANCE = s.KEYS.replace("k AS (", "k0 AS (", 1) + """,
k AS (SELECT * FROM k0 UNION SELECT run_id, seq, concat('source:', source, ':doc:', seq + 5) FROM fx_hits WHERE seq % 4 = 0)"""


#: Columns that are fused like the ids.
_MORE = ("openalex_id", "semantic_scholar_id", "dblp_key", "open_access_url")
_LIST = "array_to_string(list(x ORDER BY o_), '|')"

QUERIES = {
    "n1_norm": (
        lambda spark, d: view(spark, d, "fx_papers").select("seq", norm.norm_strong("title").alias("strong"), norm.norm_weak("abstract").alias("weak"), norm.norm_token("title").alias("token")),
        f"SELECT seq, {s.strong('title')} AS strong, {s.strong('abstract')} AS weak, nullif(array_to_string(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), ' '), '') AS token FROM fx_papers",
    ),
    "n2_n4_identifiers": (
        lambda spark, d: view(spark, d, "fx_papers").select("seq", norm.norm_doi("doi").alias("doi"), norm.norm_arxiv("arxiv_id").alias("arxiv"), norm.arxiv_from_doi("doi").alias("alias"), norm.norm_pmid("pmid").alias("pmid"), norm.norm_source_id("paper_id", "internal").alias("own")),
        f"SELECT seq, {s.doi('doi')} AS doi, {s.arxiv('arxiv_id')} AS arxiv, {s.arxiv_of_doi('doi')} AS alias, {s.pmid('pmid')} AS pmid, nullif(trim(lower(paper_id)), '') AS own FROM fx_papers",
    ),
    "n5_identifier_sets": (
        lambda spark, d: norm.identifier_sets(view(spark, d, "fx_papers")).select("seq", *(F.array_join(F.col("ids")[k], ",").alias(k) for k in norm.SCHEMES)),
        f"SELECT seq, coalesce({s.openalex('openalex_id')}, '') AS openalex_id, coalesce({s.scholar('semantic_scholar_id')}, '') AS semantic_scholar_id, coalesce({s.dblp('dblp_key')}, '') AS dblp_key, coalesce({s.doi('doi')}, '') AS doi, coalesce({s.arxiv('arxiv_id')}, '') AS arxiv_id, coalesce({s.pmid('pmid')}, '') AS pmid FROM fx_papers",
    ),
    "n6_compare_ids": (
        lambda spark, d: (lambda p: norm.compare_ids(p.select(F.col("seq").alias("l"), (F.col("seq") + 1).alias("seq"), F.col("ids").alias("left_ids"), F.col("doi").alias("left_doi")).join(p.select("seq", F.col("ids").alias("right_ids"), F.col("doi").alias("right_doi")), "seq")).select("l", F.col("seq").alias("r"), "same", "evidence"))(
            norm.identifier_sets(view(spark, d, "fx_papers").withColumn("doi", F.expr("CASE WHEN seq % 6 = 0 THEN concat('10.48550/arXiv.2401.', lpad(CAST(seq AS STRING), 5, '0')) ELSE doi END")).withColumn("seq", F.col("seq")))),
        f"""WITH p AS (SELECT seq, CASE WHEN seq % 6 = 0 THEN concat('10.48550/arXiv.2401.', lpad(CAST(seq AS VARCHAR), 5, '0')) ELSE doi END AS doi, arxiv_id, pmid, openalex_id, semantic_scholar_id, dblp_key FROM fx_papers),
        i AS (SELECT seq, {s.openalex('openalex_id')} AS o, {s.scholar('semantic_scholar_id')} AS s2, {s.dblp('dblp_key')} AS b, {s.doi('doi')} AS d, list_filter([{s.arxiv('arxiv_id')}, {s.arxiv_of_doi('doi')}], lambda x: x IS NOT NULL) AS a, {s.arxiv_of_doi('doi')} AS al, {s.pmid('pmid')} AS p FROM p)
        SELECT x.seq AS l, y.seq AS r,
          CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN x.d = y.d WHEN len(x.a) > 0 AND len(y.a) > 0 THEN list_has_any(x.a, y.a) WHEN x.p IS NOT NULL AND y.p IS NOT NULL THEN x.p = y.p
            WHEN x.o IS NOT NULL AND y.o IS NOT NULL THEN x.o = y.o WHEN x.s2 IS NOT NULL AND y.s2 IS NOT NULL THEN x.s2 = y.s2 WHEN x.b IS NOT NULL AND y.b IS NOT NULL THEN x.b = y.b END AS same,
          CASE WHEN x.d IS NOT NULL AND y.d IS NOT NULL THEN 'doi' WHEN len(x.a) > 0 AND len(y.a) > 0 THEN CASE WHEN list_has_any(x.a, y.a) AND coalesce(x.al, y.al) IS NOT NULL THEN 'arxiv_doi_alias' ELSE 'arxiv_id' END WHEN x.p IS NOT NULL AND y.p IS NOT NULL THEN 'pmid'
            WHEN x.o IS NOT NULL AND y.o IS NOT NULL THEN 'openalex_id' WHEN x.s2 IS NOT NULL AND y.s2 IS NOT NULL THEN 'semantic_scholar_id' WHEN x.b IS NOT NULL AND y.b IS NOT NULL THEN 'dblp_key' END AS evidence
        FROM i x JOIN i y ON y.seq = x.seq + 1""",
    ),
    "n7_build_texts": (
        lambda spark, d: norm.build_texts(view(spark, d, "fx_papers").withColumn("keywords", F.array("source", F.lit(" "), "lang"))).select("seq", F.sha2("embedding_text", 256).alias("embedding"), F.sha2("reranker_text", 256).alias("reranker"), "text_error"),
        """WITH p AS (SELECT seq, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS a, source, lang, coalesce(venue, 'Unknown') AS v, coalesce(CAST(year AS VARCHAR), 'Unknown') AS y FROM fx_papers)
        SELECT seq, CASE WHEN t <> '' THEN sha256(concat('Title: ', t, chr(10), 'Keywords: ', source, ', ', lang, chr(10), 'Abstract: ', substr(a, 1, 12000), chr(10), 'Venue: ', v, chr(10), 'Year: ', y)) END AS embedding,
          CASE WHEN t <> '' THEN sha256(CASE WHEN a = '' THEN t ELSE concat(t, chr(10), a) END) END AS reranker, CASE WHEN t = '' THEN 'blank title' END AS text_error FROM p""",
    ),
    "n8_text_hash": (
        lambda spark, d: view(spark, d, "fx_papers").select("seq", norm.text_hash("abstract", "m", "r").alias("h")),
        "SELECT seq, sha256(concat('m', chr(0), 'r', chr(0), 'v1', chr(0), abstract)) AS h FROM fx_papers",
    ),
    "n9_split_terms": (
        lambda spark, d: query(spark, d, "SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", F.array_join(norm.split_terms("text", 6), "|").alias("terms")),
        """WITH t AS (SELECT conv_id, turn, i, trim(parts[i]) AS x FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[,，\\n]') AS parts FROM conversations) q, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)),
        f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(x) ORDER BY i) AS r FROM t WHERE x <> ''),
        o AS (SELECT conv_id, turn, x, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS o_ FROM f WHERE r = 1)
        SELECT c.conv_id, c.turn, coalesce(string_agg(x, '|' ORDER BY o_), '') AS terms FROM conversations c LEFT JOIN o ON o.conv_id = c.conv_id AND o.turn = c.turn AND o_ <= 6 GROUP BY c.conv_id, c.turn""",
    ),
    "n10_query_language": (
        lambda spark, d: query(spark, d, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(text, '研究') WHEN turn % 5 = 1 THEN '论文' ELSE text END AS text FROM conversations").select("conv_id", "turn", norm.query_language("text").alias("language")),
        "SELECT conv_id, turn, CASE WHEN regexp_matches(t, '[一-鿿]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(t, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat(text, '研究') WHEN turn % 5 = 1 THEN '论文' ELSE text END AS t FROM conversations) q",
    ),
    "n11_links": (
        lambda spark, d: query(spark, d, "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat(split_part(split_part(url, '?', 1), '#', 1), '.PDF?x=1') ELSE url END AS url, concat('doi: 10.', 1000 + page_id, '/a(', page_id, ')') AS doi FROM pages").select("page_id", norm.pdf_url("url").alias("pdf"), norm.doi_url("doi").alias("link")),
        "SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(url, '^https?://[^/]+/') THEN concat(split_part(split_part(url, '?', 1), '#', 1), '.PDF?x=1') END AS pdf, concat('https://doi.org/10.', 1000 + page_id, '%2Fa(', page_id, ')') AS link FROM pages",
    ),
    "f1_identity_keys": (lambda spark, d: f.identity_keys(view(spark, d, "fx_hits")), f"WITH {s.KEYS} SELECT * FROM k"),
    "f1_provenance_keys": (lambda spark, d: f.identity_keys(_fused_before(spark, d)), f"WITH {_PROVENANCE} SELECT * FROM k"),
    "f2_provenance_groups": (
        lambda spark, d: f.identity_groups(_fused_before(spark, d)),
        f"""WITH RECURSIVE {_PROVENANCE}, cc(run_id, seq, label) AS (SELECT run_id, seq, seq FROM fx_hits UNION SELECT b.run_id, b.seq, cc.label FROM cc JOIN k a ON a.run_id = cc.run_id AND a.seq = cc.seq JOIN k b ON b.run_id = a.run_id AND b.key = a.key)
        SELECT run_id, seq, min(label) AS component FROM cc GROUP BY ALL""",
    ),
    "f2_identity_groups": (lambda spark, d: f.identity_groups(view(spark, d, "fx_whole_hits")), whole(f"WITH RECURSIVE {s.GROUPS} SELECT run_id, seq, component FROM m")),
    "f3_canonical": (lambda spark, d: f.canonical(groups(spark, d)), f"WITH RECURSIVE {s.GROUPS} SELECT run_id, component, seq FROM g WHERE best = 1"),
    "f4_fuse_fields": (
        lambda spark, d: f.fuse_fields(groups(spark, d, "fx_whole_hits")).withColumn("abstract", F.sha2("abstract", 256)),
        whole(f"""WITH RECURSIVE {s.GROUPS}, r AS (
          SELECT run_id, component, max(citation_count) AS citation_count, count(*) AS n_records, min(year) AS y, arg_max(trim(coalesce(abstract, '')), ROW(length(trim(coalesce(abstract, ''))), -seq)) AS a,
            arg_min(trim(venue), seq) FILTER (trim(venue) <> '') AS v, arg_min(trim(doi), seq) FILTER (trim(doi) <> '') AS d, arg_min(trim(arxiv_id), seq) FILTER (trim(arxiv_id) <> '') AS x, arg_min(trim(pmid), seq) FILTER (trim(pmid) <> '') AS p, bool_or(is_open_access) AS is_open_access, max(updated_at) AS updated_at,
            {', '.join(f"arg_min(trim({c}), seq) FILTER (trim({c}) <> '') AS f_{c}" for c in _MORE)},
            CASE WHEN bool_or(paper_type = 'article') THEN 'article' WHEN bool_or(paper_type = 'conference') THEN 'conference' ELSE arg_min(paper_type, seq) FILTER (paper_type IS NOT NULL) END AS paper_type
          FROM g GROUP BY ALL)
        SELECT r.run_id, r.component, g.paper_id, g.title, sha256(r.a) AS abstract, coalesce(g.year, r.y) AS year, coalesce(nullif(trim(g.venue), ''), r.v) AS venue, coalesce(nullif(trim(g.doi), ''), r.d) AS doi,
          coalesce(nullif(trim(g.arxiv_id), ''), r.x) AS arxiv_id, coalesce(nullif(trim(g.pmid), ''), r.p) AS pmid, r.citation_count, r.paper_type, r.n_records, r.is_open_access, r.updated_at, {', '.join(f"coalesce(nullif(trim(g.{c}), ''), r.f_{c}) AS {c}" for c in _MORE)}
        FROM r JOIN g ON g.run_id = r.run_id AND g.component = r.component AND g.best = 1"""),
    ),
    "f5_provenance": (
        lambda spark, d: f.provenance(groups(spark, d)).withColumn("subqueries", F.array_join("subqueries", ",")),
        f"""WITH RECURSIVE {s.GROUPS}, o AS (SELECT run_id, component, source, paper_id, concat('q', round) AS q, min(seq) AS o_, min(raw_rank) AS rank, max(fetched_at) AS fetched FROM g GROUP BY ALL)
        SELECT run_id, component, source, paper_id AS external_id, min(rank) AS best_rank, string_agg(q, ',' ORDER BY o_) AS subqueries, min(o_) AS first_seq, max(fetched) AS fetched_at FROM o GROUP BY run_id, component, source, paper_id""",
    ),
    "f6_merge_authors": (
        f6,
        whole(f"""WITH RECURSIVE {s.GROUPS}, a AS (
          SELECT run_id, component, seq, 1 AS pos, first_author AS name, CASE WHEN seq % 4 = 0 THEN concat('0000-', seq % 7) END AS orcid, CASE WHEN seq % 3 = 0 THEN concat('Inst ', seq % 5) END AS institution, source, concat(source, '-', seq % 11) AS sid FROM g UNION ALL
          SELECT run_id, component, seq, 2, concat('AUTHOR  ', seq % 13), NULL, NULL, source, NULL FROM g WHERE seq % 3 = 0),
        b AS (SELECT *, coalesce(lower(orcid), {s.strong('name')}) AS k, seq * 10 + pos AS o_ FROM a),
        c AS (SELECT run_id, component, k, arg_min(name, o_) AS name, arg_min(orcid, o_) FILTER (orcid IS NOT NULL) AS orcid, arg_min(institution, o_) FILTER (institution IS NOT NULL) AS institution, min(o_) AS o_ FROM b GROUP BY ALL),
        e AS (SELECT run_id, component, k, source, arg_max(sid, o_) AS sid FROM b WHERE sid IS NOT NULL GROUP BY ALL),
        h AS (SELECT run_id, component, k, string_agg(concat(source, '=', sid), ',' ORDER BY source) AS ids FROM e GROUP BY ALL)
        SELECT c.run_id, c.component, row_number() OVER (PARTITION BY c.run_id, c.component ORDER BY c.o_) AS position, name, orcid, institution, coalesce(ids, '') AS ids FROM c LEFT JOIN h ON h.run_id = c.run_id AND h.component = c.component AND h.k = c.k"""),
    ),
    "f7_merge_terms": (
        lambda spark, d: f.merge_terms(_keywords(spark, d)).withColumn("terms", F.array_join("terms", "|")),
        f"""WITH RECURSIVE {s.GROUPS}, w AS (SELECT x.run_id, g.component, g.seq * 10 + x.pos AS o_, keyword, {s.strong('keyword')} AS n FROM fx_keywords x JOIN g ON g.run_id = x.run_id AND g.seq = x.seq),
        o AS (SELECT run_id, component, n, arg_min(keyword, o_) AS x, min(o_) AS o_ FROM w WHERE n <> '' GROUP BY ALL) SELECT run_id, component, {_LIST} AS terms FROM o GROUP BY run_id, component""",
    ),
    "f8_work_family": (
        lambda spark, d: families(spark, d, "fx_whole_hits"),
        whole(f"""WITH RECURSIVE {s.GROUPS}, i AS (SELECT DISTINCT g.run_id, g.component, k FROM g, LATERAL (SELECT unnest([concat('doi:', {s.doi('doi')}), concat('arxiv:', {s.arxiv('arxiv_id')}), concat('pmid:', {s.pmid('pmid')})]) AS k) WHERE k NOT IN ('doi:', 'arxiv:', 'pmid:')),
        j AS (SELECT run_id, component, string_agg(k, '|' ORDER BY k) AS ks FROM i GROUP BY ALL)
        SELECT g.run_id, g.component, concat('work-', substr(sha256(coalesce(ks, concat('source:', source, ':', {s.strong('paper_id')}))), 1, 16)) AS work_family_id FROM g LEFT JOIN j ON j.run_id = g.run_id AND j.component = g.component WHERE g.best = 1"""),
    ),
    "f9_link_versions": (
        lambda spark, d: f.link_versions(query(spark, d, "SELECT run_id, seq AS component, concat(lang, ' ', coalesce(venue, 'none')) AS title, first_author, coalesce(year, 2000) AS year, paper_type, paper_id AS work_family_id FROM fx_papers")).select("run_id", "component", "version_family_id"),
        f"""WITH p AS (SELECT run_id, seq AS component, concat({s.strong("concat(lang, ' ', coalesce(venue, 'none'))")}, '|', {s.strong('first_author')}) AS k, coalesce(year, 2000) AS year, paper_type AS pt, paper_id FROM fx_papers),
        t AS (SELECT run_id, k FROM p WHERE pt IN ('article', 'conference', 'preprint') GROUP BY ALL HAVING bool_or(pt = 'preprint') AND bool_or(pt <> 'preprint') AND max(year) - min(year) <= 2)
        SELECT p.run_id, p.component, CASE WHEN t.k IS NULL OR pt IS NULL THEN p.paper_id ELSE concat('work-', substr(sha256(concat('version:', t.k)), 1, 16)) END AS version_family_id FROM p LEFT JOIN t ON t.run_id = p.run_id AND t.k = p.k""",
    ),
    "f10_rrf": (
        rrf,
        f"WITH RECURSIVE {s.GROUPS}, b AS (SELECT run_id, component, source, min(raw_rank) AS r FROM g GROUP BY ALL) SELECT run_id, component, round(sum(1.0 / (60 + r)), 10) AS rrf_score FROM b GROUP BY run_id, component",
    ),
    "f11_fusion_report": (
        lambda spark, d: f.fusion_report(groups(spark, d), families(spark, d)),
        f"""WITH RECURSIVE {s.GROUPS}, i AS (SELECT DISTINCT g.run_id, g.component, k FROM g, LATERAL (SELECT unnest([concat('doi:', {s.doi('doi')}), concat('arxiv:', {s.arxiv('arxiv_id')}), concat('pmid:', {s.pmid('pmid')})]) AS k) WHERE k NOT IN ('doi:', 'arxiv:', 'pmid:')),
        j AS (SELECT run_id, component, string_agg(k, '|' ORDER BY k) AS ks FROM i GROUP BY ALL),
        w AS (SELECT g.run_id, g.component, coalesce(ks, concat('source:', source, ':', paper_id)) AS fam FROM g LEFT JOIN j ON j.run_id = g.run_id AND j.component = g.component WHERE g.best = 1)
        SELECT run_id, n_input, n_fused, n_input - n_fused AS n_merged, n_families FROM (SELECT run_id, count(*) AS n_input, count(DISTINCT component) AS n_fused FROM g GROUP BY ALL) JOIN (SELECT run_id, count(DISTINCT fam) AS n_families FROM w GROUP BY ALL) USING (run_id)""",
    ),
    "f12_dedup_first": (
        f12,
        f"""WITH n AS (SELECT run_id, source, seq, coalesce(concat('d', nullif({s.doi('doi')}, '')), NULL) AS x, {s.doi('doi')} AS d, {s.arxiv('arxiv_id')} AS a, {s.pmid('pmid')} AS p, {s.strong('title')} AS t, year, {s.strong('first_author')} AS f FROM fx_papers),
        k AS (SELECT *, CASE WHEN d IS NOT NULL THEN concat('d', d) WHEN a IS NOT NULL THEN concat('a', a) WHEN p IS NOT NULL THEN concat('p', p) WHEN t <> '' AND year IS NOT NULL AND f <> '' THEN concat('t', t, '|', year, '|', f) ELSE concat('s', seq) END AS k FROM n)
        SELECT run_id, source, min(seq) AS seq FROM k GROUP BY run_id, source, k""",
    ),
    "f13_accumulate_rounds": (
        lambda spark, d: f.accumulate_rounds(view(spark, d, "fx_hits")),
        """WITH h AS (SELECT *, CASE WHEN trim(doi) <> '' THEN concat('doi:', lower(trim(doi))) WHEN trim(arxiv_id) <> '' THEN concat('arxiv:', lower(trim(arxiv_id))) WHEN trim(pmid) <> '' THEN concat('pmid:', lower(trim(pmid))) WHEN trim(openalex_id) <> '' THEN concat('openalex:', lower(trim(openalex_id))) WHEN trim(semantic_scholar_id) <> '' THEN concat('semantic_scholar:', lower(trim(semantic_scholar_id))) WHEN trim(dblp_key) <> '' THEN concat('dblp:', lower(trim(dblp_key))) ELSE concat('id:', lower(trim(paper_id))) END AS identity FROM fx_hits),
        o AS (SELECT *, row_number() OVER (PARTITION BY run_id, identity ORDER BY round, seq) AS a, row_number() OVER (PARTITION BY run_id, identity ORDER BY round DESC, seq DESC) AS z FROM h)
        SELECT x.run_id, x.identity, x.round AS first_round, x.seq AS first_seq, y.paper_id AS last_paper_id FROM o x JOIN o y ON y.run_id = x.run_id AND y.identity = x.identity AND x.a = 1 AND y.z = 1""",
    ),
    "f14_accumulate_sources": (
        lambda spark, d: f.accumulate_sources(view(spark, d, "fx_hits"), query(spark, d, "SELECT run_id, source FROM fx_hits WHERE seq % 97 = 0")),
        """SELECT run_id, source, count(*) AS n, row_number() OVER (PARTITION BY run_id ORDER BY min(ROW(round, seq))) AS position, bool_or(seq % 97 = 0) AS degraded FROM fx_hits GROUP BY run_id, source""",
    ),
    "f15_aggregate_rounds": (
        f15,
        """WITH r AS (SELECT run_id, round, count(*) AS n, count_if(year IS NULL) AS fi, count(DISTINCT coalesce(doi, paper_id)) - count_if(year IS NULL) AS k, max(CASE WHEN seq % 17 = 0 THEN concat('e', seq) END) AS error FROM fx_hits GROUP BY run_id, round),
        b AS (SELECT run_id, round, source, min(seq) AS a, count_if(year IS NULL) AS n, max(CASE WHEN seq % 17 = 0 THEN concat('e', seq) END) AS e FROM fx_hits GROUP BY run_id, round, source),
        c AS (SELECT run_id, source, min(ROW(round, a)) AS o_, sum(n) AS n, arg_max(e, round) FILTER (e IS NOT NULL) AS e FROM b GROUP BY run_id, source),
        d AS (SELECT run_id, string_agg(source, ',' ORDER BY o_) AS routes, string_agg(concat(source, '=', n), ',' ORDER BY source) AS reasons, coalesce(string_agg(concat(source, '=', e), ',' ORDER BY source) FILTER (e IS NOT NULL), '') AS errors FROM c GROUP BY run_id)
        SELECT r.run_id, CAST(sum(r.n) AS BIGINT) AS normalized, CAST(sum(fi) AS BIGINT) AS filtered, CAST(sum(k) AS BIGINT) AS kept, arg_max(error, round) FILTER (error IS NOT NULL) AS error, max(round) AS rounds,
          CAST(greatest(sum(r.n) - sum(fi) - sum(k), 0) AS BIGINT) AS merged, sum(r.n) - sum(fi) - sum(k) >= 0 AS valid, any_value(routes) AS routes, any_value(reasons) AS reasons, any_value(errors) AS errors FROM r JOIN d ON d.run_id = r.run_id GROUP BY r.run_id""",
    ),
}
