"""Coverage, stop rules and query evolution over retrieval rounds (C1-C12, J8), for all runs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import casefold, collapse
from folium.operators.components import greedy_keep
from folium.sources.store import saved

#: The domains that add sources to a route; sets, whose order has no meaning.
COMPUTING = ("ai", "artificial intelligence", "computer science", "computer vision", "cs", "data mining", "machine learning", "natural language processing", "nlp", "software engineering")
BIOMEDICAL = ("biology", "biomedical", "biomedicine", "clinical medicine", "drug discovery", "epidemiology", "genetics", "health", "life science", "life sciences", "medical", "medicine", "neuroscience", "pharmacology", "public health")
QUERYABLE = ("must_include", "dataset", "method")
SIMILAR = 0.8
_NONE = lambda: F.array().cast("array<string>")


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), _NONE())


def relevance_flags(papers: DataFrame, intents: DataFrame) -> DataFrame:
    """Papers with high and partial; intents have must, datasets, methods, year_start and year_end."""
    strict = (F.size(_list("must")) + F.size(_list("datasets")) + F.size(_list("methods")) > 0) | F.col("year_start").isNotNull()
    rows = papers.join(intents.select("run_id", strict.alias("_strict")), "run_id")
    high = F.coalesce(F.col("status") == "satisfied", F.lit(False)) | (~F.col("_strict") & (F.col("relevance").isNull() | (F.col("relevance") >= 0.5)))
    return rows.withColumns({"high": high, "partial": F.coalesce(F.col("status") == "uncertain", F.lit(False))}).drop("_strict")


def metadata_text(papers: DataFrame) -> Column:
    words = F.array_join("keywords", " ") if "keywords" in papers.columns else F.lit(None)
    return casefold(F.concat_ws("\n", "title", "abstract", words, "venue", "paper_type"))


#: The lists of an intent whose terms must be held, with the kind and severity of the gap that a term leaves.
HELD = (("must", "must_include", 1.0), ("datasets", "dataset", 0.9), ("methods", "method", 0.8))


def _tagged(field: str, kind: str, more: Callable[[Column], Column]) -> Column:
    """The distinct terms of a list, each with its kind of gap and one thing more."""
    return F.transform(F.array_distinct(_list(field)), lambda c: F.struct(F.lit(kind).alias("gap_type"), c.alias("constraint"), more(c)))


def _terms(intents: DataFrame, fields: tuple = HELD) -> DataFrame:
    """(run_id, gap_type, constraint, severity), a row for each distinct term of the lists."""
    each = (_tagged(field, kind, lambda c: F.lit(severity).alias("severity")) for field, kind, severity in fields)
    return intents.select("run_id", F.explode(F.concat(*each)).alias("x")).select("run_id", "x.*")


def read_matches(papers: DataFrame, intents: DataFrame, fields: tuple = HELD) -> DataFrame:
    """papers (of relevance_flags) with in_years and held: (gap_type, constraint) of their run's terms that a high paper's
    metadata holds. Each text is folded and read once, whatever is counted from it."""
    folded = (_tagged(field, kind, lambda c: casefold(F.trim(c)).alias("term")) for field, kind, _ in fields)
    asked = intents.select("run_id", F.filter(F.concat(*folded), lambda x: x["term"] != "").alias("_terms"), F.struct("year_start", "year_end").alias("_years"))
    # A lambda's variable is computed once; the text itself in the inner lambda would be folded for each term.
    found = F.transform(F.array(metadata_text(papers)), lambda text: F.transform(F.filter("_terms", lambda x: F.contains(text, x["term"])), lambda x: F.struct(x["gap_type"].alias("gap_type"), x["constraint"].alias("constraint"))))[0]
    in_years = F.coalesce(F.col("year").between(F.col("_years.year_start"), F.col("_years.year_end")), F.lit(False))
    return papers.join(asked, "run_id").withColumns({"in_years": in_years, "held": F.when(F.col("high"), found)}).drop("_terms", "_years")


def _paper_counts(read: DataFrame, keys: list[str]) -> DataFrame:
    return read.groupBy(*keys).agg(F.count_if("high").alias("n_high"), F.count_if("partial").alias("n_partial"), F.count_if(F.col("high") & F.col("in_years")).alias("n_years"))


def _held_counts(read: DataFrame, keys: list[str]) -> DataFrame:
    return read.select(*keys, F.explode("held").alias("x")).groupBy(*keys, "x.gap_type", "x.constraint").agg(F.count("*").alias("n"))


def match_counts(papers: DataFrame, intents: DataFrame, field: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, by, constraint, n): high papers whose metadata holds the term; terms without one have 0.

    papers come from relevance_flags; by names further columns, such as the round, that papers are counted for.
    """
    keys, fields = ["run_id", *by], tuple(f for f in HELD if f[0] == field)
    terms = _terms(intents, fields).select("run_id", "constraint")
    n = _held_counts(read_matches(papers, intents, fields), keys).drop("gap_type")
    all_ = terms.join(papers.select(*keys).distinct(), "run_id") if by else terms
    return all_.join(n, [*keys, "constraint"], "left").select(*keys, "constraint", F.coalesce("n", F.lit(0)).alias("n"))


def coverage_gaps(papers: DataFrame, intents: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, by, gap_type, constraint, severity, n, position), the worst first.

    papers come from relevance_flags; sources are (run_id, by, source, n, unavailable).
    """
    keys, read = ["run_id", *by], read_matches(papers, intents)
    return gaps_of_counts(_paper_counts(read, keys), _held_counts(read, keys), intents, sources, by)


def gaps_of_counts(counts: DataFrame, held: DataFrame, intents: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """C3 from counts (run_id, by, n_high, n_years), a row where there are papers, and held (run_id, by, gap_type, constraint),
    the terms that some paper holds."""
    keys = ["run_id", *by]
    gap = lambda df, kind, severity, n="n": df.select(*keys, F.lit(kind).alias("gap_type"), "constraint", severity.cast("double").alias("severity"), F.col(n).alias("n"))
    terms = _terms(intents).join(counts.select(*keys), "run_id") if by else _terms(intents)
    missing = terms.join(held.select(*keys, "gap_type", "constraint"), [*keys, "gap_type", "constraint"], "left_anti")
    out = missing.select(*keys, "gap_type", "constraint", F.col("severity").cast("double").alias("severity"), F.lit(0).cast("long").alias("n"))
    counted = counts.join(intents.select("run_id", "year_start", "year_end", "target_count"), "run_id")
    years = F.concat(F.col("year_start").cast("string"), F.lit("-"), F.col("year_end").cast("string"))
    short = (F.col("target_count") - F.col("n_high")) / F.col("target_count")
    for more in (
        gap(counted.where("year_start is not null and n_years = 0").withColumn("constraint", years), "year_range", F.lit(0.85), "n_years"),
        gap(sources.where("n = 0").withColumn("constraint", F.col("source")), "source", F.when(F.col("unavailable"), 0.7).otherwise(0.45)),
        gap(counted.where("n_high < target_count").withColumn("constraint", F.lit("high_relevance")), "result_count", short, "n_high"),
    ):
        out = out.unionByName(more)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("severity"), "gap_type", "constraint")))


def stop_reason() -> Column:
    """The first that holds, over n_high, target_count, n_constraint_gaps, budget_exhausted, round, max_rounds,
    has_query, n_sources, n_unavailable, n_new and minimum_new."""
    down = (F.col("n_sources") > 0) & (F.col("n_unavailable") > 0) & (F.col("n_unavailable") >= F.col("n_sources"))
    few = (F.col("round") > 1) & (F.col("round") < F.col("max_rounds") - 1) & (F.col("n_new") < F.col("minimum_new"))
    return (
        F.when((F.col("n_high") >= F.col("target_count")) & (F.col("n_constraint_gaps") == 0), "target_met").when(F.col("budget_exhausted"), "budget").when(F.col("round") >= F.col("max_rounds"), "max_rounds")
        .when(~F.col("has_query"), "no_query").when(down, "sources_down").when(few, "few_new")
    )


def coverage_report(papers: DataFrame, gaps: DataFrame, rounds: DataFrame, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """C4: rounds (run_id, by, and the columns of stop_reason) with counts, marginal gain, stop reason and what follows."""
    return _report(papers.groupBy("run_id", *by).agg(F.count_if("high").alias("n_high"), F.count_if("partial").alias("n_partial")), gaps, rounds, ["run_id", *by])


def _report(counts: DataFrame, gaps: DataFrame, rounds: DataFrame, keys: list[str]) -> DataFrame:
    g = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.count_if(F.col("gap_type").isin("must_include", "dataset", "method", "year_range")).alias("n_constraint_gaps"))
    rows = rounds.join(counts, keys, "left").join(g, keys, "left").na.fill(0, ["n_high", "n_partial", "n_gaps", "n_constraint_gaps"])
    rows = rows.withColumns({"marginal_gain": F.least(F.lit(1.0), F.col("n_new") / F.col("target_count")), "stop_reason": stop_reason()})
    return rows.withColumn("should_continue", F.col("stop_reason").isNull() & (F.col("n_gaps") > 0))


def replay_rounds(hits: DataFrame, intents: DataFrame, max_rounds: int = 3, minimum_new: int = 1) -> DataFrame:
    """The report of each round on all that was seen up to it, with whether the run got that far.

    hits are (run_id, round, seq, identity columns, status, relevance, ...); a paper is seen from its first round on, with
    the last values. A run executes rounds up to its first one with a stop reason.
    """
    # Texts are read where they lie: only flags and the terms held are shuffled, and what is counted by first round is summed.
    read = read_matches(relevance_flags(hits, intents), intents).select("run_id", "identity", "round", "seq", F.struct("high", "partial", "in_years", "held").alias("x"))
    last = read.groupBy("run_id", "identity").agg(F.min("round").alias("first_round"), F.max_by("x", F.struct("round", "seq")).alias("x"))
    seen = saved(last.select("run_id", "first_round", "x.*"), "replayed-papers")
    rounds = intents.select("run_id", "target_count", F.explode(F.sequence(F.lit(1), F.lit(max_rounds))).alias("round"))
    upto = lambda df: df.join(rounds.select("run_id", "round"), "run_id").where("first_round <= round")
    by_first = _paper_counts(seen, ["run_id", "first_round"])
    counts = upto(by_first).groupBy("run_id", "round").agg(*(F.sum(c).alias(c) for c in ("n_high", "n_partial", "n_years")))
    held = upto(_held_counts(seen, ["run_id", "first_round"])).select("run_id", "round", "gap_type", "constraint").distinct()
    sources = hits.select("run_id", "source").distinct().join(rounds.select("run_id", "round"), "run_id").join(hits.groupBy("run_id", "round", "source").agg(F.count("*").alias("n")), ["run_id", "round", "source"], "left")
    sources = sources.select("run_id", "round", "source", F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("unavailable"))
    gaps = gaps_of_counts(counts, held, intents, sources, ("round",))
    new = by_first.select("run_id", F.col("first_round").alias("round"), F.col("n_high").alias("n_new"))
    state = rounds.join(new, ["run_id", "round"], "left").na.fill(0, ["n_new"]).withColumns({
        "budget_exhausted": F.lit(False), "max_rounds": F.lit(max_rounds), "has_query": F.lit(True), "n_sources": F.lit(0), "n_unavailable": F.lit(0), "minimum_new": F.lit(minimum_new)})
    report = _report(counts, gaps, state, ["run_id", "round"])
    stop = F.min(F.when(F.col("stop_reason").isNotNull(), F.col("round"))).over(Window.partitionBy("run_id"))
    return report.withColumn("executed", F.col("round") <= stop).select("run_id", "round", "n_high", "n_partial", "n_gaps", "n_new", "marginal_gain", "stop_reason", "should_continue", "executed")


def route_plan(intents: DataFrame, scholar_enabled: bool = True, scholar_key: bool = True) -> DataFrame:
    """(run_id, round, candidates, source) for rounds 1 to 3; intents have domains."""
    domains = F.transform(_list("domains"), lambda d: casefold(collapse(d)))
    some = lambda names: F.arrays_overlap(domains, F.array(*map(F.lit, names)))
    put = lambda test, *names: F.when(F.coalesce(test, F.lit(False)), F.array(*map(F.lit, names))).otherwise(_NONE())
    candidates = F.concat(F.array(F.lit("openalex")), put(F.lit(scholar_enabled and scholar_key), "semantic_scholar"), put(some(COMPUTING), "arxiv", "dblp"), put(some(BIOMEDICAL), "pubmed"))
    rows = intents.select("run_id", candidates.alias("candidates")).select("run_id", "candidates", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("round"))
    return rows.select("run_id", "round", "candidates", F.get("candidates", F.least("round", F.size("candidates")) - 1).alias("source"))


def distinct_terms(*lists: Column) -> Column:
    """Terms that differ in more than case and spaces, each by its first form, in order."""
    all_ = F.filter(F.transform(F.concat(*lists), collapse), lambda x: x != "")
    folded = F.transform(all_, casefold)
    return F.filter(all_, lambda x, i: F.array_position(folded, F.get(folded, i)) == i + 1)


def propose_queries(gaps: DataFrame, intents: DataFrame) -> DataFrame:
    """(run_id, gap, pos, query): candidate follow-up queries of each gap that a query can close.

    intents have topics, tasks, methods and datasets; gaps (run_id, gap, gap_type, constraint).
    """
    rows = gaps.where(F.col("gap_type").isin(*QUERYABLE)).join(intents.select("run_id", *(_list(c).alias(c) for c in ("topics", "tasks", "methods", "datasets"))), "run_id")
    focus = F.array(collapse(F.col("constraint")))
    first = distinct_terms(F.col("topics"), F.col("tasks"), F.col("methods"), F.col("datasets"), focus)
    other = F.when(F.col("gap_type") == "dataset", distinct_terms(focus, F.col("tasks"), F.col("topics"))).otherwise(distinct_terms(focus, F.col("datasets"), F.col("tasks"), F.col("topics")))
    texts = rows.select("run_id", "gap", F.posexplode(F.array(F.array_join(first, " "), F.array_join(other, " "))).alias("pos", "query")).where("query <> ''")
    keyed = texts.withColumn("_print", query_fingerprint("query"))
    order = Window.partitionBy("run_id", "gap", "_print").orderBy("pos")
    return keyed.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_print")


def query_tokens(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.regexp_extract_all(casefold(c), F.lit(r"(?U)([^\W_]+)"))))


def query_fingerprint(c) -> Column:
    """C9."""
    return F.sha2(F.array_join(query_tokens(c), " ").cast("binary"), 256)


def similar_classes(queries: DataFrame, t: float = SIMILAR, keys: tuple[str, ...] = ("run_id",)) -> tuple[DataFrame, DataFrame]:
    """(keys, pos, class) of every query (keys, pos, query), and (keys, a, b, similarity) of classes a after b that are alike.

    Queries of one token set are a class, named by its smallest pos; a query without tokens is its own. Only classes are
    compared: sets of similarity t share one of their first n - ceil(t n) + 1 tokens, rarest first, are of lengths within
    t, and have enough tokens left after the first that they share.
    """
    rows = saved(queries.select(*keys, "pos", query_tokens("query").alias("tokens")), "query-tokens")
    sets = saved(rows.where(F.size("tokens") > 0).groupBy(*keys, "tokens").agg(F.min("pos").alias("class")), "token-sets")
    members = rows.join(sets, [*keys, "tokens"], "left").select(*keys, "pos", F.coalesce("class", "pos").alias("class"))
    each = sets.select(*keys, F.col("class").alias("pos"), F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = each.groupBy(*keys, "token").agg(F.count("*").alias("df"))
    ranked = each.join(df, [*keys, "token"]).withColumn("r", F.row_number().over(Window.partitionBy(*keys, "pos").orderBy("df", "token")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * t) + 1).select(*keys, "token", "pos", "n", "r")
    other = prefix.select(*keys, "token", F.col("pos").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    length = (F.least("n", "nb") >= F.greatest("n", "nb") * t) & ((1 + F.least(F.col("n") - F.col("r"), F.col("nb") - F.col("rb"))) * (1 + t) >= (F.col("n") + F.col("nb")) * t - 1e-9)
    pairs = prefix.join(other, [*keys, "token"]).where((F.col("pos") > F.col("b")) & length).select(*keys, F.col("pos").alias("a"), "b").distinct()
    side = lambda name, tokens: sets.select(*keys, F.col("class").alias(name), F.col("tokens").alias(tokens))
    both = pairs.join(side("a", "ta"), [*keys, "a"]).join(side("b", "tb"), [*keys, "b"])
    similarity = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return members, both.withColumn("similarity", similarity).where(F.col("similarity") >= t).select(*keys, "a", "b", "similarity")


def class_links(members: DataFrame, links: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Every query with its class and the number of other classes that are like it."""
    n = links.select(*keys, F.col("a").alias("class")).unionByName(links.select(*keys, F.col("b").alias("class"))).groupBy(*keys, "class").agg(F.count("*").alias("n_links"))
    return members.join(n, [*keys, "class"], "left").select(*keys, "pos", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_queries(queries: DataFrame, t: float = SIMILAR, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, a, b, similarity) of a run's queries (keys, pos, query), a after b, whose token sets are alike: the pairs
    of similar_classes, expanded to their members. n queries of one set make n * (n - 1) / 2 rows."""
    members, links = similar_classes(queries, t, keys)
    members = saved(members, "query-classes")
    pairs = links.unionByName(members.join(queries.select(*keys, "pos", query_tokens("query").alias("_t")), [*keys, "pos"]).where("size(_t) > 0").select(*keys, F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity")).distinct())
    side = lambda name, pos: members.select(*keys, F.col("class").alias(name), F.col("pos").alias(pos))
    each = pairs.join(side("a", "x"), [*keys, "a"]).join(side("b", "y"), [*keys, "b"]).where((F.col("a") != F.col("b")) | (F.col("x") > F.col("y")))
    return each.select(*keys, F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "similarity")


def accept_queries(candidates: DataFrame, known: DataFrame, per_gap: int | None = None, t: float = SIMILAR) -> DataFrame:
    """Candidates (run_id, gap, pos, query) with accepted, in the order of pos within a run.

    One goes if it has no token, or is too similar to a known query (run_id, query) or to an accepted one before it. With
    per_gap, gaps take their first per_gap ones, gap by gap in the order of their first pos, so that only what was really
    accepted binds later gaps; there is a round for each gap of a run, not for each query.
    """
    all_ = known.select("run_id", (-F.row_number().over(Window.partitionBy("run_id").orderBy("query"))).cast("long").alias("pos"), "query").unionByName(candidates.select("run_id", F.col("pos").cast("long").alias("pos"), "query"))
    pairs = saved(similar_queries(all_, t), "similar-queries")
    against = pairs.where("a > 0 and b < 0").select("run_id", F.col("a").alias("pos")).distinct()
    live = candidates.where(F.size(query_tokens("query")) > 0).select("run_id", "gap", F.col("pos").cast("long").alias("pos")).join(against, ["run_id", "pos"], "left_anti")
    among = pairs.where("a > 0 and b > 0").select("run_id", "a", "b")
    side = lambda df, c: df.select("run_id", F.col("pos").alias(c))
    greedy = lambda rows: greedy_keep(rows.select("run_id", F.col("pos").alias("id")), among.join(side(rows, "a"), ["run_id", "a"], "left_semi").join(side(rows, "b"), ["run_id", "b"], "left_semi"), ["run_id"], "queries").where("kept").select("run_id", F.col("id").alias("pos"))
    if per_gap is None:
        kept = greedy(live)
    else:
        first = candidates.groupBy("run_id", "gap").agg(F.min("pos").alias("at")).withColumn("turn", F.row_number().over(Window.partitionBy("run_id").orderBy("at")))
        live = saved(live.join(first.select("run_id", "gap", "turn"), ["run_id", "gap"]), "live-queries")
        kept = None
        for turn in range(1, (live.agg(F.max("turn")).first()[0] or 0) + 1):
            rows = live.where(F.col("turn") == turn)
            if kept is not None:
                bound = among.join(side(kept, "b"), ["run_id", "b"], "left_semi").select("run_id", F.col("a").alias("pos"))
                rows = rows.join(bound, ["run_id", "pos"], "left_anti")
            new = greedy(rows).withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))).where(F.col("_r") <= per_gap).drop("_r")
            kept = saved(new if kept is None else kept.unionByName(new), "accepted-queries")
        kept = side(live, "pos").limit(0) if kept is None else kept
    kept = kept.withColumn("_kept", F.lit(True))
    return candidates.withColumn("pos", F.col("pos").cast("long")).join(kept, ["run_id", "pos"], "left").withColumn("accepted", F.coalesce("_kept", F.lit(False))).drop("_kept")


def evolution_report(gaps: DataFrame, accepted: DataFrame) -> DataFrame:
    """(run_id, n_generated, n_skipped, warnings) of gaps (run_id, gap, gap_type, constraint) and accept_queries's rows.

    A gap that no query can close is left to the controller; one without an accepted query has nothing new to ask.
    """
    n = accepted.where("accepted").groupBy("run_id", "gap").agg(F.count("*").alias("n"))
    rows = gaps.join(n, ["run_id", "gap"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    warning = F.when(~F.col("gap_type").isin(*QUERYABLE), F.concat(F.col("constraint"), F.lit(": left to the controller"))).when(F.col("n") == 0, F.concat(F.col("constraint"), F.lit(": no new query")))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("gap", "w")))), lambda x: x["w"])
    return rows.withColumn("w", warning).groupBy("run_id").agg(F.sum("n").alias("n_generated"), F.count("w").alias("n_skipped"), listed.alias("warnings"))


def gate_proposals(proposals: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """C11: a model's first two queries (run_id, pos, query, language) that are English, short and new; else the rules' ones."""
    first = proposals.where("pos <= 2 and language = 'en' and char_length(trim(query)) between 1 and 300").withColumn("gap", F.lit("model"))
    good = accept_queries(first.select("run_id", "gap", "pos", "query"), known).where("accepted").select("run_id", "pos", "query", F.lit("model").alias("origin"))
    rest = rules.select("run_id", F.col("pos").cast("long").alias("pos"), "query", F.lit("rules").alias("origin")).join(good.select("run_id").distinct(), "run_id", "left_anti")
    return good.unionByName(rest)


def pending_queue(pending: DataFrame, generated: DataFrame, executed: DataFrame, model_first: bool = True) -> DataFrame:
    """(run_id, position, query): each query not yet executed, once whatever its case; a model's ones go first."""
    rank = {True: (1, 0), False: (0, 1)}[model_first]
    rows = pending.select("run_id", F.lit(rank[0]).alias("o"), "pos", "query").unionByName(generated.select("run_id", F.lit(rank[1]).alias("o"), "pos", "query")).withColumn("key", casefold(F.trim("query")))
    rows = rows.join(executed.select("run_id", casefold(F.trim("query")).alias("key")).distinct(), ["run_id", "key"], "left_anti").where("key <> ''")
    first = rows.groupBy("run_id", "key").agg(F.min(F.struct("o", "pos", "query")).alias("first"))
    return first.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("first")).cast("int").alias("position"), F.col("first.query").alias("query"))
