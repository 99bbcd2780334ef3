"""Rank within a run and keep the first n (R1-R10); the planner turns each window and its bound into a grouped top-n."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import norm_weak
from folium.operators.filters import validate_evidence
from folium.operators.vector_index import VectorIndex
from folium.sources.store import Steps, saved, scratch

SEMANTIC_KEEP, PAIR_KEEP, WINDOW = 60, 24, 20
OVER_FETCH = 5
BLOCK, SPREAD = 4, 16  # a term search's first block holds BLOCK * k texts, each later one SPREAD times as many
LEAST_RELEVANCE, HIGH_RELEVANCE = 0.35, 0.60


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rank_semantic(papers: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = SEMANTIC_KEEP) -> DataFrame:
    """Papers (run_id, paper_id, rrf_score) by the product of their vector and their run's query vector."""
    rows = papers.join(vectors.select("paper_id", "embedding"), "paper_id").join(queries.select("run_id", F.col("embedding").alias("_query")), "run_id")
    scored = rows.withColumn("semantic_score", F.round(dot("embedding", "_query"), 10)).drop("embedding", "_query")
    return top(scored, ["run_id"], [F.desc("semantic_score"), F.desc_nulls_last("rrf_score"), F.asc("paper_id")], k)


def rank_rrf(papers: DataFrame, k: int = SEMANTIC_KEEP, reason: str = "vectors unavailable") -> DataFrame:
    """R2: the order without vectors, and why."""
    return top(papers, ["run_id"], [F.desc_nulls_last("rrf_score"), F.asc("paper_id")], k).withColumn("ranking_note", F.lit(reason))


def rank_pair(papers: DataFrame, k: int = PAIR_KEEP) -> DataFrame:
    """By pair_score, then the scores before it; a null score is below all others."""
    return top(papers, ["run_id"], [F.desc_nulls_last("pair_score"), F.desc_nulls_last("semantic_score"), F.desc_nulls_last("rrf_score"), F.asc("paper_id")], k)


def join_assessments(papers: DataFrame, assessments: DataFrame) -> DataFrame:
    """Papers with their run's first assessment (run_id, paper_id, batch, item, relevance, status, evidence, reason)."""
    first = top(assessments, ["run_id", "paper_id"], [F.asc("batch"), F.asc("item")], 1, "_r").drop("_r", "batch", "item")
    return papers.join(first, ["run_id", "paper_id"], "left")


def rank_assessed(papers: DataFrame, assessments: DataFrame, targets: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Papers (run_id, paper_id, position, scores) ranked by assessment, and (run_id, n_rejected, n_truncated).

    Only the first `window` are looked at. One of low relevance goes; one without evidence that holds is uncertain, as is a
    satisfied one of less than high relevance; one that does not satisfy goes. A run none of whose papers is assessed keeps
    its order.
    """
    seen = papers.where(F.col("position") <= window)
    checked = validate_evidence(seen, assessments).drop("evidence")
    rows = join_assessments(seen, checked).join(targets.select("run_id", F.least("target_count", F.lit(window)).alias("_target")), "run_id")
    any_ = F.max(F.col("relevance").isNotNull()).over(Window.partitionBy("run_id"))
    proof = F.coalesce(F.size("valid_evidence"), F.lit(0)) > 0
    safe = F.when(F.col("relevance").isNull() | ~proof, "uncertain").when((F.col("relevance") < HIGH_RELEVANCE) & (F.col("status") == "satisfied"), "uncertain").otherwise(F.col("status"))
    rows = rows.withColumns({"_any": any_, "final_status": safe})
    gone = F.col("_any") & F.coalesce((F.col("relevance") < LEAST_RELEVANCE) | (F.col("final_status") == "not_satisfied"), F.lit(False))
    rows = rows.withColumn("_gone", gone)
    order = [F.desc_nulls_last("relevance"), F.desc_nulls_last("pair_score"), F.desc_nulls_last("semantic_score"), F.desc_nulls_last("rrf_score"), F.asc(F.when(F.col("final_status") == "satisfied", 0).otherwise(1)), F.asc("paper_id")]
    live = rows.where("not _gone")
    rank = F.when(F.col("_any"), F.row_number().over(Window.partitionBy("run_id").orderBy(*order))).otherwise(F.row_number().over(Window.partitionBy("run_id").orderBy("position")))
    ranked = live.withColumn("rank", rank)
    reason = F.when(proof, F.col("reason")) if "reason" in assessments.columns else F.lit(None).cast("string")
    kept = ranked.where(F.col("rank") <= F.col("_target")).withColumn("recommendation", reason).drop("_any", "_gone", "_target")
    over = papers.groupBy("run_id").agg(F.greatest(F.count("*") - window, F.lit(0)).alias("_over"))
    n = rows.groupBy("run_id").agg(F.count_if("_gone").alias("n_rejected"), F.greatest(F.count_if(~F.col("_gone")) - F.max("_target"), F.lit(0)).alias("_cut")).join(over, "run_id")
    return kept, n.select("run_id", "n_rejected", (F.col("_cut") + F.col("_over")).alias("n_truncated"))


def batch_status(papers: DataFrame, calls: DataFrame, size: int = 10) -> DataFrame:
    """Papers (run_id, position) with batch and whether its call (run_id, batch, ok) failed, and whether all did."""
    rows = papers.withColumn("batch", F.floor((F.col("position") - 1) / size).cast("int") + 1)
    joined = rows.join(calls.select("run_id", "batch", "ok"), ["run_id", "batch"], "left").withColumn("failed", ~F.coalesce("ok", F.lit(False))).drop("ok")
    return joined.withColumn("fallback", F.min("failed").over(Window.partitionBy("run_id")))


def page_results(results: DataFrame, requests: DataFrame, by: str = "request_id") -> DataFrame:
    """Rows (request_id, ...) of one page of each request (request_id, sort, page, page_size); a page past the end is the last.

    by is the column that ties rows to requests: request_id where each request has rows of its own, run_id where requests
    show a run's. The rows of a key are ranked once for each order asked for, as deep as the deepest page, which bounds what a
    task hands on; a page fetches its positions.
    The directions of year_desc and citation_desc hold for the whole key, ties of ids included.
    """
    keys = {
        "relevance": [F.desc_nulls_last("relevance"), F.desc_nulls_last("pair_score"), F.desc_nulls_last("semantic_score"), F.desc_nulls_last("rrf_score"), F.asc(F.when(F.col("status") == "satisfied", 0).otherwise(1)), F.asc("paper_id")],
        "year_desc": [F.desc_nulls_last("year"), F.desc("paper_id")],
        "citation_desc": [F.desc("citation_count"), F.desc(F.coalesce("year", F.lit(0))), F.desc("paper_id")],
    }
    deepest = requests.agg(F.max(F.coalesce(F.col("page").cast("bigint") * F.col("page_size"), F.lit(2**31 - 1)))).first()[0]
    ranked = [
        results.join(requests.where(F.col("sort") == sort).select(by), by, "left_semi").withColumns({"sort": F.lit(sort), "at": F.row_number().over(Window.partitionBy(by).orderBy(*order))}).where(F.col("at") <= F.lit(deepest))
        for sort, order in keys.items()
    ]
    totals = results.groupBy(by).agg(F.count("*").alias("total"))
    last = F.greatest(F.ceil(F.col("total") / F.col("page_size")), F.lit(1))
    asked = requests.select(*dict.fromkeys(["request_id", by]), "sort", "page", "page_size").join(totals, by).withColumn("shown_page", F.least("page", last))
    first = (F.col("shown_page") - 1) * F.col("page_size") + 1
    places = asked.withColumn("at", F.explode(F.sequence(first.cast("int"), (first + F.col("page_size") - 1).cast("int"))))
    return places.join(functools.reduce(DataFrame.unionByName, ranked), [by, "sort", "at"])


def sort_library(library: DataFrame, sort: str) -> DataFrame:
    """Library with position; year orders put unknown years last, ties go by updated_at and id the same way."""
    orders = {
        "updated_desc": [F.desc("updated_at"), F.desc("item_key")], "year_desc": [F.desc_nulls_last("year"), F.desc("updated_at"), F.desc("item_key")],
        "year_asc": [F.asc_nulls_last("year"), F.asc("updated_at"), F.asc("item_key")], "title_asc": [F.asc(F.lower("title")), F.asc("updated_at"), F.asc("item_key")],
    }
    return library.orderBy(*orders[sort])


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, over: int = OVER_FETCH, index: VectorIndex | None = None, exact: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k active ones among the k * over nearest vectors of each query, by
    inner product; so a query can come up short, and shortfalls() says by how much.

    index holds the vectors; without one it is built for this search. vectors (vec_id, status) say what is active now.
    """
    index = index or VectorIndex.build(vectors, scratch(queries.sparkSession, "vector-index"))
    active = index.nearest(queries, k * over, exact=exact).drop("n").join(vectors.where("status = 'active'").select("vec_id"), "vec_id", "left_semi")
    return top(active.select("query_id", "vec_id", "score"), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def shortfalls(queries: DataFrame, hits: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, missing) of queries with fewer than k hits."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").distinct().join(n, "query_id", "left").select("query_id", (k - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def _grams(word: Column, n: Column | int) -> Column:
    """The distinct runs of n letters of a word; the word itself if it is no longer."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, n)))


def _candidates(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id) of texts that hold one of the query's terms."""
    return postings.select("id", F.explode("held").alias("t")).join(terms.select("query_id", "t"), "t").select("query_id", "id").distinct()


def term_search(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the share of a query's terms that stand in the text, best k; zero isn't listed.

    corpus is (id, search_text) in lower case with single spaces. Terms longer than one letter are found as substrings; as
    they hold no space, a term stands in a text if it stands in one of its words. So the distinct words of the corpus meet
    the distinct terms by the terms' first three letters (two, of a term of two), and the texts meet by their words. Terms
    are numbered, and a word brings all of its terms in one row, as short terms stand in very many words: these are the
    postings (id, held), a row for each text with the numbers of its terms.

    Postings are read in blocks of ascending ids, each SPREAD times the one before and the last one all the rest. Ties go
    to the smaller id, so once a query has k texts that hold at least m of its n terms, a later text must hold m + 1; it
    then holds one of the n - m rarest terms, and only the texts that do are paired with the query and counted. A query
    whose k texts hold all its terms is done.
    """
    spark = queries.sparkSession
    terms = queries.select("query_id", F.array_distinct(F.filter(F.split(norm_weak("text"), " "), lambda t: F.length(t) > 1)).alias("terms")).where("size(terms) > 0")
    each = terms.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    numbers = saved(each.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t")), "terms")
    heads = numbers.select("t", "term", F.substring("term", 1, 3).alias("gram"))
    held = corpus.select("id", F.explode(F.array_distinct(F.split("search_text", " "))).alias("word")).where("word <> ''")
    words = held.select("word").distinct()
    grams = words.select("word", F.explode(F.array_union(_grams(F.col("word"), 3), _grams(F.col("word"), 2))).alias("gram"))
    found = grams.join(heads, "gram").where(F.contains("word", "term")).groupBy("word").agg(F.collect_list("t").alias("ts"))
    postings = saved(held.join(found, "word").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("held")), "postings")
    df = postings.select(F.explode("held").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "term"))
    each = saved(each.join(numbers, "term").join(df, "t", "left").withColumn("rare", rare).drop("df", "term"), "query-terms")
    asked = each.groupBy("query_id").agg(F.max("n").alias("n"), F.collect_list("t").alias("asked"))
    bounds, size = [None], BLOCK * k
    for _ in range(3):
        last = corpus.select("id").orderBy("id").limit(size).agg(F.max("id").alias("id"), F.count("*").alias("n")).first()
        if last["n"] < size or last["id"] is None:
            break
        bounds, size = [*bounds, last["id"]], size * SPREAD
    steps, best, open_ = Steps(spark, "term-search"), None, each
    for i, low in enumerate(bounds):
        block = postings if low is None else postings.where(F.col("id") > F.lit(low))
        if i + 1 < len(bounds):
            inside = F.col("id") <= F.lit(bounds[i + 1])
            block = block.where(inside | F.col("id").isNull() if low is None else inside)
        pairs = _candidates(block, open_)
        counted = pairs.join(asked, "query_id").join(block, "id").withColumn("m", F.size(F.array_intersect("asked", "held"))).select("query_id", "id", (F.col("m") / F.col("n")).alias("score"), "m")
        best = steps.put(top(counted if best is None else best.drop("rank").unionByName(counted), ["query_id"], [F.desc("score"), F.asc("id")], k))
        reached = best.where(F.col("rank") == k).select("query_id", "m")
        open_ = each.join(reached, "query_id", "left").where(F.col("rare") <= F.col("n") - F.coalesce("m", F.lit(0))).drop("m")
        if i + 1 < len(bounds) and open_.isEmpty():
            break
    return best.drop("m")


def finalize(papers: DataFrame, vectors: DataFrame, queries: DataFrame, scores: DataFrame, assessments: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cascade of R1, R3 and R4, and the counts of each run's stages.

    A run without a query vector, or none of whose papers has a vector, goes on by R2's order; `fallback` says so. The
    coverage of what is kept is coverage_report's (C4), which takes kept as its papers.
    """
    one = rank_semantic(papers, vectors, queries)
    left = rank_rrf(papers.join(one.select("run_id").distinct(), "run_id", "left_anti")).withColumn("semantic_score", F.lit(None).cast("double"))
    both = one.withColumn("ranking_note", F.lit(None).cast("string")).unionByName(left)
    two = rank_pair(both.drop("rank").join(scores.select("run_id", "paper_id", "pair_score"), ["run_id", "paper_id"], "left"))
    kept, counts = rank_assessed(two.withColumnRenamed("rank", "position"), assessments, targets)
    n = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    stages = n(papers, "n_candidates").join(n(both, "n_semantic"), "run_id", "left").join(n(two, "n_pair"), "run_id", "left").join(n(kept, "n_final"), "run_id", "left").join(counts, "run_id", "left").na.fill(0)
    noted = left.groupBy("run_id").agg(F.lit(True).alias("fallback"))
    return kept, stages.join(noted, "run_id", "left").withColumn("fallback", F.coalesce("fallback", F.lit(False)))
