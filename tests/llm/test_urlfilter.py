"""The as-of join against a loop over all entries."""

import datetime as dt
import random
from urllib.parse import urlsplit

from folium.llm import urlfilter as u

D = dt.date(2024, 1, 1)


def matches(pattern, url):
    parts = urlsplit(url)
    host, path = (parts.hostname or "").rstrip("."), [s for s in parts.path.split("/") if s]
    name, *rest = [s for s in pattern.split("/") if s]
    name = name.lower()
    if rest:
        return host == name and path[: len(rest)] == rest
    return host == name or (host.endswith("." + name) and "." in name)


def brute(url, day, entries):
    best = None
    for pattern in {e[0] for e in entries}:
        own = sorted((e[2], e[1]) for e in entries if e[0] == pattern and e[2] <= day)
        if own and matches(pattern, url):
            last = max(x[0] for x in own)
            if not any(a == "remove" for d, a in own if d == last):
                best = max(best or ("", None), (pattern, last), key=lambda x: (len(x[0]), x[0]))
    return best


def test_random(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org", "deep.c.b.org"]
    entries = [(rng.choice(hosts) + rng.choice(["", "", "/p", "/p/q"]), rng.choice(["add", "remove"]), D + dt.timedelta(rng.randrange(400))) for _ in range(60)]
    captures = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/r?x=1', '/pp#f'])}", D + dt.timedelta(rng.randrange(420))) for i in range(500)]
    got = u.blocked(spark.createDataFrame(captures, "id int, url string, fetched_on date"), spark.createDataFrame(entries, "pattern string, action string, listed_on date")).collect()
    assert len(got) == 500
    for r in got:
        want = brute(r["url"], r["fetched_on"], entries)
        assert (r["blocked"], r["rule"], r["listed_on"]) == ((True, *want) if want else (False, None, None))


def test_odd_rows(spark):
    captures = [(1, None, D), (2, "not a url", D), (3, "HTTPS://User@Bad.COM.:80/A", D), (4, "http://bad.com/x", None), (5, "http://ok.com/" + "s/" * 3000, D), (3, "HTTPS://User@Bad.COM.:80/A", D)]
    entries = [("Bad.com", "add", D), ("bad.com", "add", D), (None, "add", D), ("ok.com", None, D), ("ok.com", "add", None), ("ok.com", "drop", D), ("", "add", D), ("ok.com/s/s/", "add", D), ("ok.com/s/s", "remove", D)]
    df = spark.createDataFrame(captures, "id int, url string, fetched_on date").selectExpr("*", "'r' as rule", "1 as key", "2 as month")
    lists = spark.createDataFrame(entries, "pattern string, action string, listed_on date")
    got = u.blocked(df, lists)
    assert sorted((r["id"], r["blocked"], r["rule"], r["key"]) for r in got.collect()) == [(1, False, None, 1), (2, False, None, 1), (3, True, "bad.com", 1), (3, True, "bad.com", 1), (4, False, None, 1), (5, False, None, 1)]
    assert u.blocked(df.where("false"), lists).count() == 0
    assert u.blocked(df, lists.where("false")).where("blocked").count() == 0
