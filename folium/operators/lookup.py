"""Lookups among stored results, libraries, caches and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.operators.ranking import top

COOLDOWN, LONGEST_COOLDOWN, LEAST_COOLDOWN = 60, 300, 30


def latest_papers(results: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The row of each paper_id in the newest result (updated_at, then run_id) that holds it."""
    rows = results if ids is None else results.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    return top(rows, ["paper_id"], [F.desc("updated_at"), F.desc("run_id"), F.asc("seq")], 1, "_r").drop("_r")


def resolve_papers(requests: DataFrame, results: DataFrame, library: DataFrame) -> DataFrame:
    """(request_id, position, paper_id, origin, title): from results first, then from the library if the scope allows.

    requests are (request_id, ids, scope); the order of ids stays, and what isn't found goes.
    """
    asked = requests.select("request_id", "scope", F.posexplode("ids").alias("position", "paper_id"))
    first = latest_papers(results).select("paper_id", F.col("title").alias("t1"))
    second = library.select("paper_id", F.col("title").alias("t2"))
    rows = asked.join(first, "paper_id", "left").join(second, "paper_id", "left")
    allowed = F.when(F.col("scope") == "all", F.col("t2"))
    return rows.withColumns({"title": F.coalesce("t1", allowed), "origin": F.when(F.col("t1").isNotNull(), "results").when(allowed.isNotNull(), "library")}).where("origin is not null").select("request_id", "position", "paper_id", "origin", "title")


def incomplete_requests(requests: DataFrame, resolved: DataFrame, least: int = 1, most: int = 50) -> DataFrame:
    """(request_id, reason): too few or many ids, a repeated one, or one that isn't found."""
    found = resolved.groupBy("request_id").agg(F.count("*").alias("n"))
    rows = requests.join(found, "request_id", "left")
    reason = F.when(~F.size("ids").between(least, most), "size").when(F.size(F.array_distinct("ids")) < F.size("ids"), "repeated").when(F.coalesce("n", F.lit(0)) < F.size("ids"), "missing")
    return rows.select("request_id", reason.alias("reason")).where("reason is not null")


def run_history(states: DataFrame, results: DataFrame, n: int, missing: DataFrame | None = None) -> DataFrame:
    """The n runs updated last, with whether their result is stored; runs reported missing are left out."""
    ready = results.select("run_id").distinct().withColumn("_ready", F.lit(True))
    rows = states if missing is None else states.join(missing.select("run_id").distinct(), "run_id", "left_anti")
    return rows.orderBy(F.desc("updated_at"), "run_id").limit(n).join(ready, "run_id", "left").withColumn("result_ready", F.coalesce("_ready", F.lit(False))).drop("_ready")


def map_vector_hits(hits: DataFrame, records: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_key, score, rank): hits of active records whose item is current, an item once, the best k."""
    rows = hits.join(records.where("status = 'active'").select("vec_id", "paper_id"), "vec_id").join(items.select("paper_id", "item_key"), "paper_id")
    best = rows.groupBy("query_id", "item_key").agg(F.max("score").alias("score"))
    return top(best, ["query_id"], [F.desc("score"), F.asc("item_key")], k)


def translation_worklist(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts (id, field, text) with text_hash and the cached translation, null where there is work to do.

    cache is (id, field, text_hash, translation); a changed text has another hash and so no hit.
    """
    hashed = texts.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    return hashed.join(cache, ["id", "field", "text_hash"], "left")


def discovery_id(source: str, url: str):
    """A web discovery's id."""
    return F.sha2(F.concat(F.col(source), F.lit("\n"), F.col(url)).cast("binary"), 256)


def in_cooldown(requests: DataFrame, penalties: DataFrame) -> DataFrame:
    """Requests (request_id, source, t) that fall into their source's cooldown, t and until in seconds.

    penalties are (source, t, retry_after); one lasts the larger of the configured time and Retry-After, 30 to 300 s. Times
    meet by their 300 s bucket and the one before, so there is no product of the two tables.
    """
    wait = F.greatest(F.lit(COOLDOWN), F.least(F.ceil(F.coalesce("retry_after", F.lit(0))), F.lit(LONGEST_COOLDOWN)))
    spans = penalties.select("source", F.col("t").alias("since"), (F.col("t") + F.greatest(F.lit(LEAST_COOLDOWN), wait)).alias("until"))
    bucket = lambda c: F.floor(F.col(c) / LONGEST_COOLDOWN)
    laid = spans.withColumn("bucket", F.explode(F.array(bucket("since"), bucket("since") + 1)))
    hits = requests.withColumn("bucket", bucket("t")).join(laid, ["source", "bucket"]).where("t >= since and t < until")
    return hits.groupBy("request_id", "source", "t").agg(F.max("until").alias("until"))
