"""Routes, reports and costs (A2-A9, N12; A1 is in facets.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import casefold

TOP_KEYWORDS, REPRESENTATIVES = 8, 3
ACADEMIC = ("openalex", "semantic_scholar", "arxiv", "dblp", "pubmed")

#: Model aliases, and prices of a million tokens (cached input, other input, output).
ALIASES = {"deepseek-chat": "deepseek-v4-flash", "deepseek-reasoner": "deepseek-v4-flash"}
PRICES = {"deepseek-v4-flash": (0.02, 1.0, 2.0), "deepseek-v4-pro": (0.025, 3.0, 6.0)}
PEAK_MINUTES = ((9 * 60, 12 * 60), (14 * 60, 18 * 60))


def top_keywords(terms: DataFrame, n: int = TOP_KEYWORDS) -> DataFrame:
    """A2: (run_id, keyword, count, rank) of terms (run_id, seq, paper_id, term); each spelling on a paper counts."""
    each = terms.select("run_id", "paper_id", "seq", F.trim("term").alias("term")).where("term <> ''").groupBy("run_id", "paper_id", "term").agg(F.min("seq").alias("seq"))
    counts = each.withColumn("key", casefold("term")).groupBy("run_id", "key").agg(F.count("*").alias("count"), F.min_by("term", F.struct("seq", "term")).alias("keyword"))
    order = Window.partitionBy("run_id").orderBy(F.desc("count"), "key")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("run_id", "keyword", "count", "rank")


def source_report(results: DataFrame, counts: DataFrame, selected: DataFrame) -> DataFrame:
    """A3: (run_id, source, recalled, final, position): selected sources first, then counted ones, then those of results.

    counts are (run_id, source, n, at) and selected (run_id, source, at); only academic sources are listed.
    """
    final = results.groupBy("run_id", "source").agg(F.count("*").alias("final"), F.min("seq").alias("final_at"))
    rows = selected.select("run_id", "source", F.col("at").alias("selected_at")).join(counts.select("run_id", "source", F.col("n").alias("recalled"), F.col("at").alias("counted_at")), ["run_id", "source"], "full").join(final, ["run_id", "source"], "full")
    rows = rows.where(F.col("source").isin(*ACADEMIC))
    order = Window.partitionBy("run_id").orderBy(F.asc_nulls_last("selected_at"), F.asc_nulls_last("counted_at"), F.asc_nulls_last("final_at"), "source")
    return rows.select("run_id", "source", F.coalesce("recalled", F.lit(0)).alias("recalled"), F.coalesce("final", F.lit(0)).alias("final"), F.row_number().over(order).alias("position"))


def synthesis(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """A4: a row for each run: totals, years, findings (five at most) and suggestions (of three gaps, else of the stop).

    coverage is (run_id, n_high, n_partial, gaps, stop_reason) with gaps an array of constraints, the worst first; its counts
    win over those of the results.
    """
    n = results.groupBy("run_id").agg(F.count("*").alias("n_papers"), F.count_if(F.col("status") == "satisfied").alias("s"), F.count_if(F.col("status") == "uncertain").alias("u"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("source").alias("n_sources"))
    rows = n.join(coverage, "run_id", "left").withColumns({"n_high": F.coalesce("n_high", "s"), "n_partial": F.coalesce("n_partial", "u")})
    findings = F.array_compact(F.array(
        F.format_string("%d papers kept, %d satisfy the constraints", "n_papers", "n_high"), F.when(F.col("n_partial") > 0, F.format_string("%d papers uncertain", "n_partial")),
        F.when(F.col("first_year").isNotNull(), F.format_string("published %d to %d", "first_year", "last_year")), F.when(F.col("n_sources") > 0, F.format_string("%d sources took part", "n_sources")),
    ))
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))
    suggestions = F.when(F.size(gaps) > 0, F.transform(F.slice(gaps, 1, 3), lambda g: F.concat(F.lit("search more for "), g))).when(F.col("stop_reason").isNotNull(), F.array(F.concat(F.lit("stopped: "), F.col("stop_reason")))).otherwise(F.array().cast("array<string>"))
    return rows.select("run_id", "n_papers", "n_high", "n_partial", "first_year", "last_year", "n_sources", F.slice(findings, 1, 5).alias("findings"), suggestions.alias("suggestions"))


def keyword_routes(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: (run_id, route, name, n, representatives, rank) and (run_id, route, position, paper_id) of terms (run_id, seq, pos,
    paper_id, term): the routes, and the papers of each as rows, so that a route of any size is never one row."""
    each = terms.select("run_id", "paper_id", F.struct("seq", "pos").alias("at"), F.trim("term").alias("term")).where("term <> ''").withColumn("route", casefold("term"))
    paper = each.groupBy("run_id", "route", "paper_id").agg(F.min(F.struct("at", "term")).alias("first"))
    n = paper.groupBy("run_id", "route").agg(F.min("first")["term"].alias("name"), F.count("*").alias("n"))
    placed = paper.withColumn("position", F.row_number().over(Window.partitionBy("run_id", "route").orderBy("first", "paper_id")))
    few = placed.where(F.col("position") <= REPRESENTATIVES).groupBy("run_id", "route").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "paper_id"))), lambda x: x["paper_id"]).alias("representatives"))
    order = Window.partitionBy("run_id").orderBy(F.desc("n"), "route")
    routes = n.join(few, ["run_id", "route"]).select("run_id", "route", "name", "n", "representatives", F.row_number().over(order).alias("rank"))
    return routes, placed.select("run_id", "route", "position", "paper_id")


def call_cost(calls: DataFrame) -> DataFrame:
    """Calls (model, prompt_tokens, completion_tokens, cache_hit_tokens, cache_miss_tokens, occurred_at_utc) with cost and peak.

    Input that is neither reported as cached nor as missed counts as missed; an unknown model costs nothing. The price
    doubles at Shanghai's peak hours.
    """
    name = F.lower(F.trim("model"))
    for alias, model in ALIASES.items():
        name = F.when(F.lower(F.trim("model")) == alias, model).otherwise(name)
    price = lambda i: F.element_at(F.create_map(*(F.lit(x) for m, p in PRICES.items() for x in (m, round(1000 * p[i])))), F.col("_model"))
    clamp = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    hit = F.least(clamp("prompt_tokens"), clamp("cache_hit_tokens"))
    miss = clamp("prompt_tokens") - hit
    minute = F.hour("_local") * 60 + F.minute("_local")
    peak = (minute >= PEAK_MINUTES[0][0]) & (minute < PEAK_MINUTES[0][1]) | (minute >= PEAK_MINUTES[1][0]) & (minute < PEAK_MINUTES[1][1])
    rows = calls.withColumns({"_model": name, "_local": F.from_utc_timestamp(F.col("occurred_at_utc").cast("timestamp"), "Asia/Shanghai")})
    known = F.col("_model").isin(*PRICES)
    rows = rows.withColumn("peak", known & peak)
    units = (hit * price(0) + miss * price(1) + clamp("completion_tokens") * price(2)) * F.when(F.col("peak"), 2).otherwise(1)  # of 1e-9, exactly
    cost = F.floor((units + 5) / 10) / 1e8
    return rows.withColumn("cost", F.when(known, cost).otherwise(F.lit(0.0))).drop("_model", "_local")


def run_usage(costs: DataFrame, requests: DataFrame) -> DataFrame:
    """Each run's tokens, cost, peak, and calls not met by a cache (run_id, n_requests, n_cache_hits, latency_ms)."""
    calls = costs.groupBy("run_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("cost"), 8).alias("cost"), F.max("peak").alias("peak"))
    other = requests.groupBy("run_id").agg(F.sum(F.greatest(F.col("n_requests") - F.col("n_cache_hits"), F.lit(0))).alias("api_calls"), F.sum("n_cache_hits").alias("cache_hits"), F.sum("latency_ms").alias("latency_ms"))
    return calls.join(other, "run_id", "left").na.fill(0, ["api_calls", "cache_hits", "latency_ms"])


def funnel(groups: DataFrame, report: DataFrame, errors: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Each run's counts from recall to what is kept, its sources' counts and numbers of errors (run_id, source), and,
    of requests (run_id, hit), how many a cache met."""
    n = groups.groupBy("run_id").agg(F.count("*").alias("normalized"), F.count_distinct("component").alias("deduplicated"))
    by_source = lambda df, name: df.groupBy("run_id", "source").count().groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count")))).alias(name))
    rows = n.join(by_source(groups, "sources"), "run_id").join(report.select("run_id", F.col("n_removed").alias("filtered"), F.col("n_kept").alias("kept"), F.col("n_families").alias("families")), "run_id", "left")
    rows = rows.join(errors.groupBy("run_id").agg(F.count("*").alias("errors")), "run_id", "left").join(by_source(errors, "source_errors"), "run_id", "left")
    if requests is not None:
        rows = rows.join(requests.groupBy("run_id").agg(F.count_if("hit").alias("cache_hits")), "run_id", "left")
    return rows.na.fill(0).withColumn("merged", F.col("normalized") - F.col("deduplicated"))


def simple_counts(recalled: DataFrame, kept: DataFrame, filtered: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Recalled, deduplicated and filtered counts."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    return n(recalled, "recalled").join(n(kept, "deduplicated"), list(keys), "left").join(n(filtered, "filtered"), list(keys), "left").na.fill(0)


def comparison_items(papers: DataFrame) -> DataFrame:
    """(run_id, paper_id, line, sources): names, year and venue with stand-ins, and the type if there is one."""
    names = F.when(F.size("authors") > 0, F.array_join("authors", ", ")).otherwise("unknown authors") if "authors" in papers.columns else F.coalesce("first_author", F.lit("unknown authors"))
    line = F.concat_ws(" · ", names, F.coalesce(F.col("year").cast("string"), F.lit("unknown year")), F.coalesce("venue", F.lit("unknown venue")), F.col("paper_type"))
    return papers.select("run_id", "paper_id", line.alias("line"), F.array_distinct("sources").alias("sources"))


