"""Identity resolution and fusion of records from several sources (F1-F15), for all runs at once.

Hits are rows (run_id, seq, paper_id, source, title, first_author, year, venue, doi, arxiv_id, pmid, abstract,
paper_type, citation_count, raw_rank, round) and, where a source gives them, openalex_id, semantic_scholar_id, dblp_key,
open_access_url, is_open_access, updated_at and fetched_at; seq is a run's input order. Payload columns join only after
the narrow (run_id, seq, component) table is settled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import arxiv_from_doi, casefold, norm_arxiv, norm_doi, norm_pmid, norm_source_id, norm_strong
from folium.operators.components import components, greedy_first
from folium.sources.store import saved

RRF_K = 60


def _tagged(tag: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(tag), value))


#: The columns of platforms' own ids, and the platforms.
PLATFORM_IDS = {"openalex_id": "openalex", "semantic_scholar_id": "semantic_scholar", "dblp_key": "dblp"}


def _given(df: DataFrame, c: str, kind: str = "string") -> Column:
    """The column, or null where a source does not give it."""
    return F.col(c) if c in df.columns else F.lit(None).cast(kind)


def identity_keys(hits: DataFrame) -> DataFrame:
    """(run_id, seq, key): own id, DOI, arXiv id, PMID, and the ids on other platforms, which name the same record as its
    own id there; the title key only for records without DOI, arXiv id and PMID. A record that was fused before names every
    record it came from: source_records, an array of (source, external_id), if hits have it."""
    cross = [_tagged("doi:", norm_doi("doi")), _tagged("arxiv:", norm_arxiv("arxiv_id")), _tagged("arxiv:", arxiv_from_doi("doi")), _tagged("pmid:", norm_pmid("pmid"))]
    title, author = F.nullif(F.col("title_norm"), F.lit("")), F.nullif(F.col("author_norm"), F.lit(""))
    fallback = F.when(F.coalesce(*cross).isNull(), F.concat(F.lit("title:"), title, F.lit("|"), F.col("year").cast("string"), F.lit("|"), author))
    normal = hits.withColumns({"title_norm": norm_strong("title"), "author_norm": norm_strong("first_author"), "id_norm": norm_strong("paper_id")})
    own = F.concat(F.lit("source:"), F.col("source"), F.lit(":"), F.col("id_norm"))
    there = [_tagged(f"source:{name}:", norm_source_id(_given(hits, c), name)) for c, name in PLATFORM_IDS.items()]
    keys = normal.select("run_id", "seq", F.explode(F.array_distinct(F.array_compact(F.array(own, *cross, *there, fallback)))).alias("key"))
    if "source_records" not in hits.columns:
        return keys
    each = hits.select("run_id", "seq", F.explode("source_records").alias("r")).where("r.source is not null").select("run_id", "seq", "r.source", norm_strong("r.external_id").alias("external_id"))
    named = each.where("external_id <> ''").select("run_id", "seq", F.concat(F.lit("source:"), "source", F.lit(":"), "external_id").alias("key"))
    return keys.unionByName(named).distinct()


def identity_groups(hits: DataFrame) -> DataFrame:
    """(run_id, seq, component); component is the smallest seq of the group.

    A record's keys are hung onto the smallest record of each key, so a key held by n records makes n - 1 edges, and keys
    held once make none.
    """
    keys = saved(identity_keys(hits), "identity-keys")
    first = keys.groupBy("run_id", "key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = keys.join(first, ["run_id", "key"]).select("run_id", F.col("seq").alias("a"), F.col("first").alias("b"))
    found = components(edges, ["run_id"], "identity")
    return hits.select("run_id", "seq").join(found.withColumnRenamed("id", "seq"), ["run_id", "seq"], "left").select("run_id", "seq", F.coalesce("root", "seq").alias("component"))


def grouped(hits: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """hits with component."""
    return hits.join(identity_groups(hits) if groups is None else groups, ["run_id", "seq"])


def _full(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False)).cast("int")


def _quality(groups: DataFrame) -> list[Column]:
    formal = F.coalesce(F.col("paper_type").isin("article", "conference"), F.lit(False)).cast("int")
    return [F.coalesce(F.col("doi") != "", F.lit(False)).cast("int"), formal, _full("abstract"), _full("venue"), _full("first_author"), F.coalesce(_given(groups, "open_access_url") != "", F.lit(False)).cast("int")]


def canonical(groups: DataFrame) -> DataFrame:
    """(run_id, component, seq) of each group's canonical record, the earliest of the most complete ones."""
    best = F.max_by("seq", F.struct(*_quality(groups), -F.col("seq")))
    return groups.groupBy("run_id", "component").agg(best.alias("seq"))


def fuse_fields(groups: DataFrame) -> DataFrame:
    """one row for each group, its fields merged from all its records; open access holds if one record says so."""
    order = F.struct(*_quality(groups), -F.col("seq"))
    of_best = lambda c: F.max_by(c, order)
    first = lambda c: F.min_by(F.col(c), F.when(F.trim(c) != "", F.col("seq")))
    text = lambda c: F.trim(F.when(F.trim(of_best(c)) != "", of_best(c)).otherwise(first(c)))
    longest = F.max_by("abstract", F.struct(F.char_length(F.trim(F.coalesce("abstract", F.lit("")))), -F.col("seq")))
    kind = F.when(F.max(F.col("paper_type") == "article"), "article").when(F.max(F.col("paper_type") == "conference"), "conference").otherwise(F.min_by("paper_type", F.when(F.col("paper_type").isNotNull(), F.col("seq"))))
    more = {c: text(c).alias(c) for c in (*PLATFORM_IDS, "open_access_url")} | {"is_open_access": F.max("is_open_access").alias("is_open_access"), "updated_at": F.max("updated_at").alias("updated_at")}
    return groups.groupBy("run_id", "component").agg(
        *(e for c, e in more.items() if c in groups.columns), of_best("paper_id").alias("paper_id"), of_best("title").alias("title"), F.coalesce(F.trim(longest), F.lit("")).alias("abstract"), F.coalesce(of_best("year"), F.min("year")).alias("year"), text("venue").alias("venue"),
        text("doi").alias("doi"), text("arxiv_id").alias("arxiv_id"), text("pmid").alias("pmid"), F.max("citation_count").alias("citation_count"), kind.alias("paper_type"), F.count("*").alias("n_records"),
    )


def provenance(groups: DataFrame) -> DataFrame:
    """(run_id, component, source, external_id, best_rank, subqueries, first_seq, fetched_at), subqueries in order
    without repeats, and the latest fetch."""
    each = groups.select("run_id", "component", "source", F.col("paper_id").alias("external_id"), "raw_rank", "seq", F.concat(F.lit("q"), F.col("round")).alias("subquery"), _given(groups, "fetched_at", "date").alias("fetched_at"))
    once = each.groupBy("run_id", "component", "source", "external_id", "subquery").agg(F.min("seq").alias("at"), F.min("raw_rank").alias("rank"), F.max("fetched_at").alias("fetched_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "subquery"))), lambda x: x["subquery"])
    return once.groupBy("run_id", "component", "source", "external_id").agg(F.min("rank").alias("best_rank"), listed.alias("subqueries"), F.min("at").alias("first_seq"), F.max("fetched_at").alias("fetched_at"))


def merge_authors(authors: DataFrame) -> DataFrame:
    """authors (run_id, component, seq, pos, name, orcid, institution, source, source_author_id) merged.

    An author is known by ORCID, else by name; the first known institution and ORCID stay, and of a source's ids the last.
    """
    key = F.coalesce(F.nullif(F.lower(F.trim("orcid")), F.lit("")), norm_strong("name"))
    at = F.struct("seq", "pos")
    keyed = authors.withColumn("author_key", key)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    main = keyed.groupBy("run_id", "component", "author_key").agg(F.min_by("name", at).alias("name"), first("orcid").alias("orcid"), first("institution").alias("institution"), F.min(at).alias("at"))
    ids = keyed.where("source_author_id is not null").groupBy("run_id", "component", "author_key", "source").agg(F.max_by("source_author_id", at).alias("id"))
    maps = ids.groupBy("run_id", "component", "author_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "id")))).alias("source_author_ids"))
    return main.join(maps, ["run_id", "component", "author_key"], "left").withColumn("position", F.row_number().over(Window.partitionBy("run_id", "component").orderBy("at"))).drop("at")


def merge_terms(terms: DataFrame) -> DataFrame:
    """terms (run_id, component, seq, pos, term) -> (run_id, component, terms), each by its first spelling, in order."""
    at = F.struct("seq", "pos")
    once = terms.withColumn("norm", norm_strong("term")).where("norm <> ''").groupBy("run_id", "component", "norm").agg(F.min_by("term", at).alias("term"), F.min(at).alias("at"))
    return once.groupBy("run_id", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))


def work_family(groups: DataFrame) -> DataFrame:
    """F8: (run_id, component, work_family_id) from all stable ids of a group, else its canonical record's source id."""
    ids = F.array_compact(F.array(_tagged("doi:", norm_doi("doi")), _tagged("arxiv:", norm_arxiv("arxiv_id")), _tagged("pmid:", norm_pmid("pmid"))))
    own = F.concat(F.lit("source:"), F.col("source"), F.lit(":"), norm_strong("paper_id"))
    rows = groups.select("run_id", "component", F.explode_outer(ids).alias("id"), own.alias("own"), F.struct(*_quality(groups), -F.col("seq")).alias("order"))
    keys = rows.groupBy("run_id", "component").agg(F.array_sort(F.collect_set("id")).alias("keys"), F.max_by("own", "order").alias("own"))
    seed = F.when(F.size("keys") > 0, F.array_join("keys", "|")).otherwise(F.col("own"))
    return keys.select("run_id", "component", F.concat(F.lit("work-"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 16)).alias("work_family_id"))


def link_versions(fused: DataFrame) -> DataFrame:
    """fused (run_id, component, title, first_author, year, paper_type, work_family_id) with version_family_id.

    Records of one title and first author are versions of one work if a preprint and a formal record are among them, all
    years are known and lie within two years; they stay separate and share a family.
    """
    usable = F.col("paper_type").isin("article", "conference", "preprint")
    key = F.when(usable, F.concat(F.nullif(norm_strong("title"), F.lit("")), F.lit("|"), F.nullif(norm_strong("first_author"), F.lit(""))))
    keyed = fused.withColumn("version_key", key)
    tests = keyed.where("version_key is not null").groupBy("run_id", "version_key").agg(
        F.max(F.col("paper_type") == "preprint").alias("pre"), F.max(F.col("paper_type") != "preprint").alias("formal"), (F.count("year") == F.count("*")).alias("known"), (F.max("year") - F.min("year")).alias("spread"))
    good = tests.where("pre and formal and known and spread <= 2").select("run_id", "version_key", F.concat(F.lit("work-"), F.substring(F.sha2(F.concat(F.lit("version:"), F.col("version_key")).cast("binary"), 256), 1, 16)).alias("shared"))
    return keyed.join(good, ["run_id", "version_key"], "left").withColumn("version_family_id", F.coalesce("shared", "work_family_id")).drop("version_key", "shared")


def rrf(prov: DataFrame, weights: dict[str, float] | None = None, k: float = RRF_K, rank: str = "best_rank") -> DataFrame:
    """(run_id, component, rrf_score): over sources the weight divided by k + the best rank; k is positive, weights are finite
    and not negative."""
    if not k > 0 or any(not source.strip() or isinstance(w, bool) or not math.isfinite(w) or w < 0 for source, w in (weights or {}).items()):
        raise ValueError("k must be positive, sources named, and weights finite and not negative")
    best = prov.where(F.col(rank).isNotNull()).groupBy("run_id", "component", F.lower("source").alias("source")).agg(F.min(rank).alias("rank"))
    weight = F.lit(1.0)
    for source, w in (weights or {}).items():
        weight = F.when(F.col("source") == source.strip().lower(), F.lit(float(w))).otherwise(weight)
    return best.groupBy("run_id", "component").agg(F.sum(weight / (F.lit(float(k)) + F.col("rank"))).alias("rrf_score"))


def fusion_report(groups: DataFrame, families: DataFrame) -> DataFrame:
    """input, fused, merged and family counts of each run."""
    n = groups.groupBy("run_id").agg(F.count("*").alias("n_input"), F.count_distinct("component").alias("n_fused"))
    return n.withColumn("n_merged", F.col("n_input") - F.col("n_fused")).join(families.groupBy("run_id").agg(F.count_distinct("work_family_id").alias("n_families")), "run_id")


def dedup_first(papers: DataFrame, keys: list[str]) -> DataFrame:
    """papers (keys, seq, ...) kept by one source's greedy rule.

    A record with DOI, arXiv id or PMID is known by the first of them, and the earliest of each stays. Any other is dropped
    if a kept one of these has its source id, or its title, year and first author.
    """
    strong = F.coalesce(_tagged("doi:", norm_doi("doi")), _tagged("arxiv:", norm_arxiv("arxiv_id")), _tagged("pmid:", norm_pmid("pmid")))
    rows = papers.withColumn("_strong", strong)
    order = Window.partitionBy(*keys, "_strong").orderBy("seq")
    kept = rows.where("_strong is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*papers.columns)
    weak = rows.where("_strong is null")
    title = F.concat(F.nullif(norm_strong("title"), F.lit("")), F.lit("|"), F.col("year").cast("string"), F.lit("|"), F.nullif(norm_strong("first_author"), F.lit("")))
    held = weak.select(*keys, F.col("seq").alias("id"), F.explode(F.array_compact(F.array(_tagged("s:", F.concat("source", F.lit(":"), norm_strong("paper_id"))), _tagged("t:", title)))).alias("key"))
    rest = greedy_first(held, keys, "dedup").select(*keys, F.col("id").alias("seq"))
    return kept.unionByName(weak.join(rest, [*keys, "seq"], "left_semi").select(*papers.columns))


def round_identity(hits: DataFrame) -> Column:
    """a record's identity across rounds: the first of its ids, trimmed and with folded case only."""
    known = lambda tag, c: _tagged(tag, F.nullif(casefold(F.trim(_given(hits, c))), F.lit("")))
    tags = {"doi": "doi:", "arxiv_id": "arxiv:", "pmid": "pmid:"} | {c: f"{name}:" for c, name in PLATFORM_IDS.items()} | {"paper_id": "id:"}
    return F.coalesce(*(known(tag, c) for c, tag in tags.items()))


def accumulate_rounds(hits: DataFrame) -> DataFrame:
    """(run_id, identity, first_round, first_seq, last_paper_id): the last record's value at the first one's place."""
    at = F.struct("round", "seq")
    rows = hits.withColumn("identity", round_identity(hits)).groupBy("run_id", "identity").agg(F.min(at).alias("first"), F.max_by("paper_id", at).alias("last_paper_id"))
    return rows.select("run_id", "identity", F.col("first.round").alias("first_round"), F.col("first.seq").alias("first_seq"), "last_paper_id")


def accumulate_sources(hits: DataFrame, errors: DataFrame) -> DataFrame:
    """(run_id, source, n, position, degraded): counts over rounds in first-seen order; errors are (run_id, source)."""
    rows = hits.groupBy("run_id", "source").agg(F.count("*").alias("n"), F.min(F.struct("round", "seq")).alias("at"))
    bad = errors.select("run_id", "source").distinct().withColumn("degraded", F.lit(True))
    order = Window.partitionBy("run_id").orderBy("at")
    return rows.join(bad, ["run_id", "source"], "left").select("run_id", "source", "n", F.row_number().over(order).alias("position"), F.coalesce("degraded", F.lit(False)).alias("degraded"))


def aggregate_rounds(rounds: DataFrame) -> DataFrame:
    """rounds (run_id, round, normalized, filtered, kept, error) summed; merged may not be negative.

    Where rounds have them, routes (arrays of sources) are joined in order without repeats, reasons (maps of counts) are
    added up, and of errors (maps by source) each source's last one stays.
    """
    lists = _round_lists(rounds)
    sums = rounds.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in ("normalized", "filtered", "kept")), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("round"))).alias("error"), F.max("round").alias("rounds"))
    merged = F.col("normalized") - F.col("filtered") - F.col("kept")
    out = sums.withColumns({"merged": F.greatest(merged, F.lit(0)), "valid": merged >= 0})
    for more in lists:
        out = out.join(more, "run_id", "left")
    return out


def _round_lists(rounds: DataFrame) -> list[DataFrame]:
    """(run_id, column) of routes, reasons and errors, of those that rounds have."""
    out = []
    if "routes" in rounds.columns:
        each = rounds.select("run_id", "round", F.posexplode("routes").alias("pos", "source")).groupBy("run_id", "source").agg(F.min(F.struct("round", "pos")).alias("at"))
        out.append(each.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("routes")))
    for c, value in (("reasons", F.sum("value")), ("errors", F.max_by("value", "round"))):
        if c in rounds.columns:
            each = rounds.select("run_id", "round", F.explode(c).alias("name", "value")).groupBy("run_id", "name").agg(value.alias("value"))
            out.append(each.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(c)))
    return out
