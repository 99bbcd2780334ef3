"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both run.

FIXTURES.md says what each view stands for. A view is a common table expression, so nothing is registered in a session,
and the tables are read where they are asked for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Each view's name and text, in an order in which later ones use earlier ones.
VIEWS: dict[str, str] = {
    "fx_papers": r"""
SELECT d.doc_id AS seq, concat('doc:', d.doc_id) AS paper_id,
  concat('r', d.n_chars % 10, '-', CAST(floor(d.doc_id / 1000.0) AS BIGINT)) AS run_id, CAST(d.doc_id % 3 + 1 AS INT) AS round,
  CASE d.doc_id % 5 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar'
    WHEN 2 THEN 'arxiv' WHEN 3 THEN 'dblp' ELSE 'pubmed' END AS source,
  split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.lang,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(1990 + d.doc_id % 35 AS INT) END AS year,
  CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.source END AS venue,
  concat('Author ', d.n_chars % 97) AS first_author,
  CASE WHEN d.doc_id % 2 = 0 THEN concat(CASE WHEN d.doc_id % 4 = 0
    THEN 'https://doi.org/' ELSE 'DOI:' END, '10.5555/', substr(md5(d.text), 1, 12), '.') END AS doi,
  CASE WHEN d.doc_id % 3 = 0 THEN concat('arXiv:2401.', lpad(CAST(d.n_chars AS STRING), 5, '0'),
    'v', d.doc_id % 3 + 1) END AS arxiv_id,
  CASE WHEN d.doc_id % 5 = 0 THEN concat('pmid:', 10000000 + d.n_chars) END AS pmid,
  CAST(d.n_chars % 500 AS INT) AS citation_count,
  CASE d.doc_id % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'preprint'
    WHEN 2 THEN 'conference' END AS paper_type,
  CASE WHEN d.doc_id % 7 < 3 THEN concat('https://openalex.org/W', substr(md5(d.text), 1, 10), '/') END AS openalex_id,
  CASE WHEN d.doc_id % 7 IN (2, 3) THEN concat('https://www.semanticscholar.org/paper/x/', substr(md5(d.text), 1, 10)) END AS semantic_scholar_id,
  CASE WHEN d.doc_id % 7 IN (4, 5) THEN concat('https://dblp.org/rec/', substr(md5(d.text), 1, 10), '.html') END AS dblp_key,
  CASE WHEN d.doc_id % 8 = 0 THEN concat('https://oa.example/', d.doc_id) END AS open_access_url,
  CASE WHEN d.doc_id % 3 > 0 THEN d.doc_id % 2 = 0 END AS is_open_access,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 300 AS INT) AS DATE) AS updated_at, CAST(DATE '2024-06-01' + CAST(d.doc_id % 90 AS INT) AS DATE) AS fetched_at
FROM documents d
""",
    "fx_hits": r"""
SELECT p.*, CAST(row_number() OVER (PARTITION BY run_id, round, source ORDER BY seq) AS INT) AS raw_rank
FROM fx_papers p
""",
    "fx_keywords": r"""
SELECT seq, paper_id, run_id, pos, keyword FROM (
  SELECT seq, paper_id, run_id, 1 AS pos, split_part(title, ' ', 1) AS keyword FROM fx_papers UNION ALL
  SELECT seq, paper_id, run_id, 2, split_part(title, ' ', 2) FROM fx_papers UNION ALL
  SELECT seq, paper_id, run_id, 3, lower(split_part(title, ' ', 1)) FROM fx_papers) k
WHERE keyword <> ''
""",
    "fx_intents": r"""
SELECT concat('r', id, '-', block) AS run_id, CAST(1990 + id AS INT) AS year_start, CAST(2015 + id AS INT) AS year_end,
  CASE id % 3 WHEN 0 THEN 'er' WHEN 1 THEN 'en' END AS must_term,
  CASE WHEN id % 4 = 0 THEN 'zz' END AS exclude_term,
  CASE WHEN id % 5 = 0 THEN 'src1' END AS venue_term,
  CASE id % 3 WHEN 0 THEN 'machine learning' WHEN 1 THEN 'public health' ELSE 'history' END AS domain,
  CAST(5 + id AS INT) AS target_count
FROM (SELECT DISTINCT n_chars % 10 AS id, CAST(floor(doc_id / 1000.0) AS BIGINT) AS block FROM documents) t
""",
    "fx_assessments": r"""
SELECT p.run_id, p.paper_id,
  CASE WHEN l.quality = 1 THEN 0.5 + (l.doc_id % 50) / 100.0 ELSE (l.doc_id % 60) / 100.0 END AS relevance,
  CASE WHEN l.toxic = 1 THEN 'not_satisfied' WHEN l.quality = 1 THEN 'satisfied' ELSE 'uncertain' END AS status,
  CASE WHEN l.doc_id % 4 = 0 THEN 'no such passage' ELSE substr(p.title, 1, 12) END AS evidence
FROM labels l JOIN fx_papers p ON p.seq = l.doc_id
""",
    "fx_results": r"""
SELECT h.*, a.relevance, a.status, CAST(h.seq % 100 AS DOUBLE) / 100 AS pair_score,
  CASE WHEN h.seq % 6 = 0 THEN NULL ELSE CAST(h.seq % 37 AS DOUBLE) / 37 END AS semantic_score
FROM fx_hits h LEFT JOIN fx_assessments a ON a.paper_id = h.paper_id
""",
    "fx_runs": r"""
SELECT o_orderkey AS run_id, o_orderdate AS updated_at, CAST(floor(o_totalprice) AS BIGINT) AS latency_ms,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status
FROM orders
""",
    "fx_usage": r"""
SELECT event_id AS call_id, user_id AS run_id, ts AS occurred_at_utc,
  CASE event_type WHEN 'signup' THEN 'deepseek-chat' WHEN 'click' THEN 'deepseek-v4-flash'
    WHEN 'view' THEN 'deepseek-v4-pro' WHEN 'purchase' THEN 'deepseek-v4-flash' ELSE 'unknown' END AS model,
  CAST(floor(value * 1000) AS BIGINT) AS prompt_tokens, CAST(event_id % 700 AS BIGINT) AS completion_tokens,
  CAST(event_id % 900 AS BIGINT) AS cache_hit_tokens, event_type
FROM events
""",
    "fx_library_log": r"""
SELECT user_id AS item_key, event_id AS seq, ts,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'update' ELSE 'save' END AS action,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('note ', event_id % 50) END AS note,
  CASE event_id % 4 WHEN 0 THEN 'reading' WHEN 1 THEN 'read' ELSE 'unread' END AS reading_status,
  concat('kw', event_id % 13) AS keyword
FROM events
""",
    "fx_graph_edges": r"""
SELECT run_id, src, dst FROM (
  SELECT CAST(floor(l_orderkey / 200.0) AS BIGINT) AS run_id, l_partkey AS src,
    lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dst
  FROM lineitem) e
WHERE dst IS NOT NULL
""",
    "fx_graph_nodes": r"""
SELECT n.run_id, n.id, p.p_name AS title, CASE WHEN n.id % 9 = 0 THEN NULL ELSE CAST(1970 + p.p_size AS INT) END AS year,
  p.p_brand AS source, CASE WHEN n.id % 4 = 0 THEN p.p_name END AS family, round(p.p_retailprice / 3000, 6) AS relevance
FROM (SELECT run_id, src AS id FROM fx_graph_edges UNION SELECT run_id, dst FROM fx_graph_edges) n
JOIN part p ON p.p_partkey = n.id
""",
    "fx_discoveries": r"""
SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS snippet,
  CAST(page_id % 100 AS DOUBLE) / 100 AS score
FROM pages
""",
    "fx_vectors": r"""
SELECT vec_id, concat('doc:', vec_id) AS paper_id, embedding, label,
  CASE vec_id % 9 WHEN 0 THEN 'inactive' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'active' END AS status
FROM embeddings
""",
}


def whole(sql: str) -> str:
    """A text over the views of whole runs: ten runs hold all documents, whereas a run of fx_papers ends with its block of ids."""
    return re.sub(r"\bfx_(papers|hits|results)\b", r"fx_whole_\1", sql)


VIEWS |= {whole(v): whole(VIEWS[v]).replace("concat('r', d.n_chars % 10, '-', CAST(floor(d.doc_id / 1000.0) AS BIGINT))", "concat('r', d.n_chars % 10)") for v in ("fx_papers", "fx_hits", "fx_results")}


def needed(sql: str) -> list[str]:
    """The views that a text uses, directly or not, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        new = {v for v in re.findall(r"\bfx_\w+", todo.pop()) if v in VIEWS} - found
        found |= new
        todo += [VIEWS[v] for v in new]
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """sql after the views it uses, as one statement; sql may itself start with WITH."""
    chain = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not chain:
        return sql
    if own:
        return f"WITH {own[1] or ''}{chain},\n{sql[own.end():]}"
    return f"WITH {chain}\n{sql}"


def doubles(sql: str) -> str:
    """A text for Spark whose numbers with a point are doubles. Spark takes them for exact decimals, whereas DuckDB divides
    in doubles: 0.5 + 7 / 100.0 is then not 57 / 100.0, and papers that would tie in decimals have an order."""
    return re.sub(r"'[^']*'|\b\d+\.\d+\b", lambda m: m[0] if m[0][0] == "'" else f"{m[0]}D", sql)


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a text over the views and the tables in sf_dir."""
    text = doubles(with_views(sql))
    at = lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`{m[3] or f' {m[2]}'}"
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(\s+(?!(?:WHERE|JOIN|LEFT|UNION|GROUP|ORDER|ON|CROSS|INNER)\b)[A-Za-z]\w*)?", at, text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
