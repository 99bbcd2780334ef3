"""Pieces of the checking SQL that several queries share, in DuckDB's dialect."""

from __future__ import annotations


def strong(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


def doi(x: str) -> str:
    return f"nullif(rtrim(trim(regexp_replace(lower(trim({x})), '^(https?://(dx\\.)?doi\\.org/|doi:)', '')), ' .;,:)]}}'), '')"


def arxiv(x: str) -> str:
    bare = f"trim(regexp_replace(lower(trim({x})), '^(https?://arxiv\\.org/(abs|pdf)/|arxiv:)', ''))"
    return f"nullif(regexp_replace(regexp_replace(split_part({bare}, '?', 1), '\\.pdf$', ''), 'v\\d+$', ''), '')"


def arxiv_of_doi(x: str) -> str:
    return f"nullif(regexp_extract({doi(x)}, '^10\\.48550/arxiv\\.([0-9]{{4}}\\.[0-9]{{4,5}})(v\\d+)?$', 1), '')"


def pmid(x: str) -> str:
    bare = f"trim(regexp_replace(lower(trim({x})), '^(https?://pubmed\\.ncbi\\.nlm\\.nih\\.gov/|pmid:)', ''), '/ ')"
    return f"CASE WHEN regexp_matches({bare}, '^\\d+$') THEN {bare} END"


def openalex(x: str) -> str:
    return f"nullif(trim(regexp_replace(lower(trim({x})), '^https?://openalex\\.org/', ''), '/'), '')"


def scholar(x: str) -> str:
    return f"nullif(split_part(trim(regexp_replace(lower(trim({x})), '^https://www\\.semanticscholar\\.org/paper/', ''), '/'), '/', -1), '')"


def dblp(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower(trim({x})), '^https?://dblp\\.org/rec/', ''), '\\.html$', ''), '')"


#: k: (run_id, seq, key)
KEYS = f"""n AS (SELECT run_id, seq, source, paper_id, year, {doi('doi')} AS d, {arxiv('arxiv_id')} AS a, {arxiv_of_doi('doi')} AS al, {pmid('pmid')} AS p, {openalex('openalex_id')} AS o, {scholar('semantic_scholar_id')} AS s2, {dblp('dblp_key')} AS db,
  nullif({strong('title')}, '') AS t, nullif({strong('first_author')}, '') AS f FROM fx_hits),
k AS (
  SELECT run_id, seq, concat('source:', source, ':', {strong('paper_id')}) AS key FROM n UNION
  SELECT run_id, seq, concat('doi:', d) FROM n WHERE d IS NOT NULL UNION
  SELECT run_id, seq, concat('arxiv:', a) FROM n WHERE a IS NOT NULL UNION
  SELECT run_id, seq, concat('arxiv:', al) FROM n WHERE al IS NOT NULL UNION
  SELECT run_id, seq, concat('pmid:', p) FROM n WHERE p IS NOT NULL UNION
  SELECT run_id, seq, concat('source:openalex:', o) FROM n WHERE o IS NOT NULL UNION
  SELECT run_id, seq, concat('source:semantic_scholar:', s2) FROM n WHERE s2 IS NOT NULL UNION
  SELECT run_id, seq, concat('source:dblp:', db) FROM n WHERE db IS NOT NULL UNION
  SELECT run_id, seq, concat('title:', t, '|', year, '|', f) FROM n WHERE coalesce(d, a, al, p) IS NULL AND t IS NOT NULL AND year IS NOT NULL AND f IS NOT NULL)"""

#: g: hits with component, q (quality, as one sortable number) and own rank in the group
GROUPS = f"""{KEYS},
cc(run_id, seq, label) AS (SELECT run_id, seq, seq FROM fx_hits UNION SELECT b.run_id, b.seq, cc.label FROM cc JOIN k a ON a.run_id = cc.run_id AND a.seq = cc.seq JOIN k b ON b.run_id = a.run_id AND b.key = a.key),
m AS (SELECT run_id, seq, min(label) AS component FROM cc GROUP BY ALL),
g AS (
  SELECT h.*, m.component, row_number() OVER (PARTITION BY h.run_id, m.component ORDER BY
    (h.doi IS NOT NULL AND h.doi <> '') DESC, coalesce(h.paper_type IN ('article', 'conference'), false) DESC, (trim(coalesce(h.abstract, '')) <> '') DESC,
    (trim(coalesce(h.venue, '')) <> '') DESC, (trim(coalesce(h.first_author, '')) <> '') DESC, (coalesce(h.open_access_url, '') <> '') DESC, h.seq) AS best
  FROM fx_hits h JOIN m ON m.run_id = h.run_id AND m.seq = h.seq)"""
