"""URL filters: a temporal list joined as of each capture's fetch time.

List entries (pattern, action, listed_on) say from which date on a pattern is on the list ('add') or off it ('remove');
a pattern is a host, matching it and its subdomains, or a host and a path prefix of whole segments. Entries of a pattern
become validity intervals [date, next date): of several entries on one date 'remove' holds, so a key's history has one row
a day at most, however often it is listed. A capture (url, fetched_on) has as its keys its host, the host's parents, and
each of its path prefixes of no more segments than the deepest pattern has, and is blocked if an interval of one of them
holds its date.

The as-of join is an equi-join on (key, month): an interval is laid over the months it touches, up to the last month in
the captures, so a key with many entries meets only its month's ones; a hot host makes one large partition of captures,
which Spark splits, and its keys are joined once for each distinct (host, path prefix, date), however often captured.

Cases: null or unreadable URLs and captures without date are never blocked; entries that are null in any column, have
another action or an unreadable pattern are ignored; repeated rows each get a row; other columns are kept, and none of
the made ones may clash with them: blocked, rule and listed_on replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"
_PATH = r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """The lower-case host of a URL without port, user and last dot; '' if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit("."))


def keys(url: Column, deepest: int) -> Column:
    """The host and its parents of two labels at least, and the host with each prefix of its path of up to deepest segments."""
    name, path = host(url), F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when((F.size(path) > 0) & F.lit(deepest > 0), F.transform(F.sequence(F.lit(1), F.least(F.size(path), F.lit(max(deepest, 1)))), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(path, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(name != "", F.array_distinct(F.concat(parents, prefixes))).otherwise(F.array().cast("array<string>"))


def pattern_key(pattern: Column) -> Column:
    """A pattern as a key: its host in lower case, and its path, if any, without empty segments."""
    bare = F.regexp_replace(F.trim(pattern), r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    parts = F.filter(F.split(F.regexp_extract(bare, r"^([^?#]*)", 1), "/"), lambda s: s != "")
    name = F.rtrim(F.lower(F.regexp_replace(F.get(parts, 0), r":\d*$", "")), F.lit("."))
    return F.when(F.size(parts) > 1, F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/"))).otherwise(name)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, rule, since, until) of each stretch in which a pattern is on the list; until is null if it still is."""
    usable = entries.select(pattern_key(F.col("pattern")).alias("key"), F.lower("action").alias("action"), F.col("listed_on").cast("date").alias("since"))
    usable = usable.where("key <> '' and action in ('add', 'remove') and since is not null").groupBy("key", "since").agg(F.max("action").alias("action"))
    order = Window.partitionBy("key").orderBy("since")
    return usable.withColumn("until", F.lead("since").over(order)).where("action = 'add'").select("key", F.col("key").alias("rule"), "since", "until")


def _months(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def blocked(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with blocked, the longest matching rule and the date since which it was listed."""
    kept = [c for c in captures.columns if c not in ("blocked", "rule", "listed_on")]
    day = F.col("fetched_on").cast("date")
    span = captures.agg(_months(F.min(day)).alias("first"), _months(F.max(day)).alias("last")).first()
    spans = intervals(entries)
    deepest = spans.agg(F.max(F.char_length("key") - F.char_length(F.replace("key", F.lit("/"), F.lit(""))))).first()[0] or 0  # one number
    distinct = captures.select(F.col("url").alias("_url"), day.alias("_day")).where("_url is not null and _day is not null").distinct()
    # Only distinct captures are joined, with columns of our own.
    probes = distinct.select("_url", "_day", F.explode(keys(F.col("_url"), deepest)).alias("key"), _months(F.col("_day")).alias("month"))
    first = F.greatest(_months(F.col("since")), F.lit(span["first"] or 0))
    last = F.least(F.coalesce(_months(F.col("until")), F.lit(span["last"] or 0)), F.lit(span["last"] or 0))
    laid = spans.where(first <= last).withColumn("month", F.explode(F.sequence(first, last)))
    hits = probes.join(laid, ["key", "month"]).where("_day >= since and (until is null or _day < until)")
    best = hits.groupBy("_url", "_day").agg(F.max_by(F.struct("rule", "since"), F.struct(F.length("rule"), "rule")).alias("_hit"))
    out = captures.join(best, (captures["url"] == best["_url"]) & (captures["fetched_on"].cast("date") == best["_day"]), "left")
    return out.select(*(captures[c] for c in kept), best["_hit"].isNotNull().alias("blocked"), best["_hit"]["rule"].alias("rule"), best["_hit"]["since"].alias("listed_on"))
