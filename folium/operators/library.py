"""State folded from change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.norm import casefold
from folium.operators.fusion import PLATFORM_IDS

ACTIVE = ("pending", "running")
SEGMENT_ROWS = 100_000
_TAGS = "array<struct<seq: bigint, pos: int, tag: string, key: string>>"
INTERRUPTED = "interrupted: the process ended before the run did"


def library_key(papers: DataFrame) -> Column:
    """L1: the first of a paper's ids, each with its kind; only DOI prefixes are taken off."""
    bare = lambda c: F.nullif(casefold(F.trim(c)), F.lit("")) if c in papers.columns else F.lit(None).cast("string")
    doi = F.nullif(F.trim(F.regexp_replace(bare("doi"), r"^(?:https?://doi\.org/|doi:)", "")), F.lit(""))
    tagged = lambda tag, v: F.when(v.isNotNull(), F.concat(F.lit(tag), v))
    return F.coalesce(tagged("doi:", doi), tagged("arxiv:", bare("arxiv_id")), tagged("pmid:", bare("pmid")), *(tagged(f"{name}:", bare(c)) for c, name in PLATFORM_IDS.items()), tagged("paper:", bare("paper_id")))


def fold_saves(log: DataFrame) -> DataFrame:
    """L2: the state of each item_key after its saves (item_key, seq, ts, note, reading_status, tags, paper_id).

    The last paper; all tags by their first form in order; the last note given; the last status but unread.
    """
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq")))
    main = log.groupBy("item_key").agg(
        F.max_by("paper_id", "seq").alias("paper_id"), last("note", F.col("note").isNotNull()).alias("note"),
        F.coalesce(last("reading_status", F.col("reading_status") != "unread"), F.lit("unread")).alias("reading_status"), F.min("ts").alias("saved_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_saves"),
    )
    return main.join(_tags(log, ["item_key"]), "item_key", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def _tags(log: DataFrame, keys: list[str]) -> DataFrame:
    each = log.select(*keys, "seq", F.posexplode("tags").alias("pos", "tag")).withColumn("_key", casefold("tag"))
    once = each.groupBy(*keys, "_key").agg(F.min(F.struct("seq", "pos", "tag")).alias("first"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["tag"]).alias("tags"))


def created(log: DataFrame) -> DataFrame:
    """L2: each save with whether it made its item."""
    return log.withColumn("created", F.row_number().over(Window.partitionBy("item_key").orderBy("seq")) == 1)


def log_parts(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """L2, L3: a summary (item_key, segment, deleted, whole, fresh) of what each segment of a log does to each item.

    A segment is a stretch of the log, and of an item's rows those of a greater segment have the greater seq: a day, or
    SEGMENT_ROWS numbers where none is given, so that an item with ever so many rows is many groups. After its last delete,
    if it has one (deleted), a segment sets what `whole` says on an item that is there, and makes of one that isn't what
    `fresh` says (null without a save). Summaries can be kept: merged_parts() puts them together and folded_items() reads them.
    Rows without item_key are one item, which keeps no tags.
    """
    segment = F.floor(F.col("seq") / SEGMENT_ROWS) if segment is None else segment
    group, seq = ["item_key", "segment"], F.col("seq")
    by = Window.partitionBy(*group)
    save, update, paper = F.col("action") == "save", F.col("action") == "update", F.col("paper_id") if "paper_id" in log.columns else F.lit(None).cast("string")
    rows = log.select("item_key", segment.cast("long").alias("segment"), seq.cast("long").alias("seq"), "ts", "action", paper.alias("paper_id"), "note", "reading_status", "tags", "has_note", "has_status", "has_tags")
    rows = rows.withColumn("_gone", F.max(F.when(F.col("action") == "delete", seq)).over(by)).where("_gone is null or seq >= _gone")
    live = F.col("action") != "delete"
    rows = rows.withColumns({"_from": F.min(F.when(save, seq)).over(by), "_replaced": F.max(F.when(update & F.col("has_tags"), seq)).over(by)})
    set_note = (save & F.col("note").isNotNull()) | (update & F.col("has_note"))
    set_status = (save & (F.col("reading_status") != "unread")) | (update & F.col("has_status") & F.col("reading_status").isNotNull())
    tells, kinds = {"whole": live, "fresh": live & (seq >= F.col("_from"))}, {}
    for kind, when in tells.items():
        last = lambda c, of, when=when: F.max_by(F.struct(F.col(c).alias("v")), F.when(when & of, seq))
        kinds |= {
            f"{kind}_paper": last("paper_id", save), f"{kind}_note": last("note", set_note), f"{kind}_status": last("reading_status", set_status)["v"],
            f"{kind}_replaced": F.coalesce(F.max(when & (seq == F.col("_replaced"))), F.lit(False)), f"{kind}_saved": F.min(F.when(when, F.col("ts"))), f"{kind}_updated": F.max(F.when(when, F.col("ts"))), f"{kind}_n": F.count(F.when(when & save, 1)),
        }
    main = rows.groupBy(*group).agg((F.max("_gone").isNotNull()).alias("deleted"), F.max("_from").isNotNull().alias("_saved"), *(v.alias(k) for k, v in kinds.items()))
    tagged = rows.where(live & (save | (update & F.col("has_tags"))) & (F.col("_replaced").isNull() | (seq >= F.col("_replaced"))))
    each = tagged.select(*group, "seq", "_from", F.posexplode("tags").alias("pos", "tag")).withColumn("key", casefold("tag"))
    first = F.struct("seq", "pos", "tag", "key")
    once = each.groupBy(*group, "key").agg(F.min(first).alias("whole"), F.min(F.when(seq >= F.col("_from"), first)).alias("fresh"))
    tags = once.groupBy(*group).agg(*(F.array_sort(F.collect_list(kind)).alias(f"{kind}_tags") for kind in tells))
    state = lambda kind: F.struct(*(F.col(f"{kind}_{c}").alias(c) for c in ("paper", "note", "status", "replaced")), F.coalesce(f"{kind}_tags", F.array().cast(_TAGS)).alias("tags"), *(F.col(f"{kind}_{c}").alias(c) for c in ("saved", "updated", "n")))
    return main.join(tags, group, "left").select(*group, "deleted", state("whole").alias("whole"), F.when(F.col("_saved"), state("fresh")).alias("fresh"))


def _then(x: Column, y: Column) -> Column:
    """What x and after it y set."""
    known = F.transform(x["tags"], lambda t: t["key"])
    tags = F.when(y["replaced"], y["tags"]).otherwise(F.concat(x["tags"], F.filter(y["tags"], lambda t: ~F.array_contains(known, t["key"]))))
    return F.struct(
        *(F.coalesce(y[c], x[c]).alias(c) for c in ("paper", "note", "status")), (x["replaced"] | y["replaced"]).alias("replaced"), tags.alias("tags"),
        F.least(x["saved"], y["saved"]).alias("saved"), F.greatest(x["updated"], y["updated"]).alias("updated"), (x["n"] + y["n"]).alias("n"),
    )


def merged_parts(parts: DataFrame, segment: Column | None = None) -> DataFrame:
    """L2, L3: summaries of wider segments (of the whole log where none is given), in any steps with the same result."""
    both = lambda a, b: F.struct(
        b["segment"].alias("segment"), (a["deleted"] | b["deleted"]).alias("deleted"), F.when(b["deleted"], b["whole"]).otherwise(_then(a["whole"], b["whole"])).alias("whole"),
        F.when(b["deleted"] | a["fresh"].isNull(), b["fresh"]).otherwise(_then(a["fresh"], b["whole"])).alias("fresh"),
    )
    wide = parts.select("item_key", (F.lit(0) if segment is None else segment).cast("long").alias("_to"), F.struct("segment", "deleted", "whole", "fresh").alias("part"))
    lists = wide.groupBy("item_key", "_to").agg(F.array_sort(F.collect_list("part"), lambda a, b: F.when(a["segment"] < b["segment"], -1).when(a["segment"] > b["segment"], 1).otherwise(0)).alias("parts"))
    one = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0], both)
    return lists.select("item_key", "_to", one.alias("part")).select("item_key", F.col("_to").alias("segment"), "part.deleted", "part.whole", "part.fresh")


def folded_items(parts: DataFrame) -> DataFrame:
    """L2, L3: the items (item_key, paper_id, note, reading_status, saved_at, updated_at, n_saves, tags) that the whole log leaves."""
    fresh = F.col("fresh")
    return merged_parts(parts).where("fresh is not null").select(
        "item_key", fresh["paper"]["v"].alias("paper_id"), fresh["note"]["v"].alias("note"), F.coalesce(fresh["status"], F.lit("unread")).alias("reading_status"), fresh["saved"].alias("saved_at"), fresh["updated"].alias("updated_at"), fresh["n"].alias("n_saves"), F.transform(fresh["tags"], lambda t: t["tag"]).alias("tags"),
    )


def fold_log(log: DataFrame) -> DataFrame:
    """L3: items after saves, updates and deletes (item_key, seq, ts, action, note, reading_status, tags, has_note, has_status, has_tags).

    A delete ends an item and a save starts it afresh; an update before a save does nothing. An update sets what it
    supplies: a null note clears the note, and tags replace all before them.
    """
    return folded_items(log_parts(log)).drop("paper_id", "n_saves")


def latest_states(log: DataFrame, heavy: tuple[str, ...] = ()) -> DataFrame:
    """L4: the last snapshot (run_id, updated_at, ...) of each run, without its heavy columns."""
    kept = [c for c in log.columns if c not in ("run_id", *heavy)]
    return log.groupBy("run_id").agg(F.max_by(F.struct(*kept), F.struct("updated_at", F.xxhash64(*kept))).alias("s")).select("run_id", "s.*")


def reconcile(states: DataFrame) -> DataFrame:
    """Runs left pending or running are failed, with one fixed error."""
    open_ = F.col("status").isin(*ACTIVE)
    return states.withColumns({
        "status": F.when(open_, "failed").otherwise(F.col("status")), "stop_reason": F.when(open_, INTERRUPTED).otherwise(F.col("stop_reason")),
        "errors": F.when(open_, F.array_union("errors", F.array(F.lit(INTERRUPTED)))).otherwise(F.col("errors")),
    })


def delete_runs(states: DataFrame, results: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(request verdicts, states left, results left): a run goes unless it is missing or still active."""
    asked = requests.select("request_id", "run_id").join(states.select("run_id", "status"), "run_id", "left")
    verdict = F.when(F.col("status").isNull(), "missing").when(F.col("status").isin(*ACTIVE), "active").otherwise("deleted")
    verdicts = asked.select("request_id", "run_id", verdict.alias("verdict"))
    gone = verdicts.where("verdict = 'deleted'").select("run_id").distinct()
    return verdicts, states.join(gone, "run_id", "left_anti"), results.join(gone, "run_id", "left_anti")
