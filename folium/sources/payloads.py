"""Tables of raw source responses mapped to paper records, discoveries, assessments and intents.

Raw rows are (run_id, round, payload, fetched_at), one for each response; a page of a longer answer also has first_rank,
the rank of its first record. JSON goes through VARIANT, so a field of the
wrong type is null rather than an error; XML through from_xml. A record keeps its place in the response as raw_rank even
where records before it are bad.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folium.functions.norm import casefold, collapse

_NO_TEXTS = lambda: F.array().cast("array<string>")
_RUN = ("run_id", "round", "fetched_at")


def _kind(v: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind)


def text(v: Column, path: str) -> Column:
    """A string that isn't blank, trimmed."""
    return F.nullif(F.trim(F.when(_kind(v, path, "STRING"), F.try_variant_get(v, path, "string"))), F.lit(""))


def whole(v: Column, path: str) -> Column:
    """An integer; a boolean or a number with a fraction isn't one."""
    return F.when(_kind(v, path, "BIGINT"), F.try_variant_get(v, path, "bigint"))


def items(v: Column, path: str) -> Column:
    """The elements of an array, none if it isn't one."""
    return F.coalesce(F.when(_kind(v, path, "ARRAY"), F.try_variant_get(v, path, "array<variant>")), F.array().cast("array<variant>"))


def texts(v: Column, path: str) -> Column:
    return F.array_compact(F.transform(items(v, path), lambda x: text(x, "$")))


def _author(name: Column, orcid: Column | None = None, institution: Column | None = None, own: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), (none if orcid is None else orcid).alias("orcid"), (none if institution is None else institution).alias("institution"), (none if own is None else own).alias("source_author_id"))


def _named(authors: Column) -> Column:
    return F.filter(authors, lambda a: a["name"].isNotNull())


def _each(raw: DataFrame, array: Column) -> DataFrame:
    """A row for each record of a response, x, with its rank."""
    first = F.col("first_rank") if "first_rank" in raw.columns else F.lit(1)
    return raw.select(*_RUN, first.alias("first"), F.posexplode(array).alias("pos", "x")).withColumn("raw_rank", (F.col("pos") + F.col("first")).cast("int")).drop("pos", "first")


def _papers(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    kinds = {"year": "int", "citation_count": "int", "is_open_access": "boolean", "references": "array<string>", "keywords": "array<string>"}
    names = ("paper_id", "title", "abstract", "authors", "year", "venue", "doi", "arxiv_id", "pmid", "citation_count", "references", "keywords", "paper_type", "openalex_id", "semantic_scholar_id", "dblp_key", "is_open_access", "open_access_url")
    given = fields | {k: v for k, v in (("references", _NO_TEXTS()), ("keywords", _NO_TEXTS()), ("citation_count", F.lit(0)), ("abstract", F.lit(""))) if k not in fields}
    return rows.select(*_RUN, F.lit(source).alias("source"), "raw_rank", *((given[n].cast(kinds[n]) if n in kinds else given[n]) .alias(n) if n in given else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names))


def restore_abstract(index: Column) -> Column:
    """The words of an inverted index, a map, in the order of their positions; of two words at one, the first in the map stays."""
    given = F.coalesce(index, F.create_map().cast("map<string,array<bigint>>"))
    places = F.flatten(F.transform(F.map_entries(given), lambda e, i: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<bigint>")), lambda p: p >= 0), lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    # A lambda's variable is computed once; an expression named in a lambda would be sorted again for each word.
    first = lambda o: F.filter(o, lambda x, i: (i == 0) | (x["p"] != F.get(o, F.greatest(i - 1, F.lit(0)))["p"]))
    return F.transform(F.array(F.array_sort(places)), lambda o: F.array_join(F.transform(first(o), lambda x: x["w"]), " "))[0]


#: The fields of a work that are read; all but the index, in which the order of keys counts, keep whatever type they have.
_WORKS = "results ARRAY<STRUCT<id: VARIANT, title: VARIANT, doi: VARIANT, ids: VARIANT, publication_year: VARIANT, cited_by_count: VARIANT, abstract_inverted_index: MAP<STRING, ARRAY<BIGINT>>, authorships: VARIANT, primary_location: VARIANT, referenced_works: VARIANT>>"


def ingest_openalex(raw: DataFrame) -> DataFrame:
    """Works under results; a DOI may stand under ids; only the first institution of an author is kept.

    A payload is parsed once, into the fields read: a variant of the whole would carry the words of all abstracts of the
    page along with each work.
    """
    rows = _each(raw, F.from_json("payload", _WORKS)["results"])
    x = F.col("x")
    authors = F.transform(items(x["authorships"], "$"), lambda a: _author(text(a, "$.author.display_name"), text(a, "$.author.orcid"), text(a, "$.institutions[0].display_name"), text(a, "$.author.id")))
    return _papers(
        rows, "openalex", paper_id=text(x["id"], "$"), title=text(x["title"], "$"), abstract=restore_abstract(x["abstract_inverted_index"]), authors=_named(authors), year=whole(x["publication_year"], "$"), venue=text(x["primary_location"], "$.source.display_name"),
        doi=F.coalesce(text(x["doi"], "$"), text(x["ids"], "$.doi")), arxiv_id=text(x["ids"], "$.arxiv"), pmid=text(x["ids"], "$.pmid"), citation_count=F.greatest(F.coalesce(whole(x["cited_by_count"], "$"), F.lit(0)), F.lit(0)), references=texts(x["referenced_works"], "$"), openalex_id=text(x["id"], "$"),
    )


_ATOM = "entry ARRAY<STRUCT<id: STRING, published: STRING, title: STRING, summary: STRING, author: ARRAY<STRUCT<name: STRING, `arxiv:affiliation`: STRING>>, link: ARRAY<STRUCT<_href: STRING, _type: STRING>>, category: ARRAY<STRUCT<_term: STRING>>, `arxiv:journal_ref`: STRING, `arxiv:doi`: STRING>>"


def _clean(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def ingest_arxiv(raw: DataFrame) -> DataFrame:
    """Entries of Atom feeds; a feed with an entry titled Error gives no records at all."""
    feeds = raw.withColumn("f", F.from_xml("payload", _ATOM, {"mode": "PERMISSIVE"})).where(~F.coalesce(F.exists("f.entry", lambda e: F.coalesce(F.trim(e["title"]) == "Error", F.lit(False))), F.lit(False)))
    rows = _each(feeds, F.col("f.entry"))
    x = F.col("x")
    path = F.btrim(F.try_url_decode(F.regexp_extract(F.trim(x["id"]), r"^[^:]+://[^/]+([^?#]*)", 1)), F.lit("/"))
    own = F.nullif(F.regexp_replace(F.regexp_replace(path, "^abs/", ""), r"v\d+$", ""), F.lit(""))
    pdf = F.filter(F.coalesce(x["link"], F.array().cast("array<struct<_href:string,_type:string>>")), lambda l: (F.trim(l["_type"]) == "application/pdf") & l["_href"].isNotNull())
    authors = F.transform(F.coalesce(x["author"], F.array().cast("array<struct<name:string,`arxiv:affiliation`:string>>")), lambda a: _author(_clean(a["name"]), institution=_clean(a["arxiv:affiliation"])))
    terms = F.array_distinct(F.array_compact(F.transform(F.coalesce(x["category"], F.array().cast("array<struct<_term:string>>")), lambda t: _clean(t["_term"]))))
    year = F.when(F.substring(F.trim(x["published"]), 1, 4).rlike(r"^\d{4}$"), F.substring(F.trim(x["published"]), 1, 4))
    return _papers(
        rows, "arxiv", paper_id=F.concat(F.lit("arxiv:"), own), title=_clean(x["title"]), abstract=F.coalesce(_clean(x["summary"]), F.lit("")), authors=_named(authors), year=year, venue=_clean(x["arxiv:journal_ref"]), doi=_clean(x["arxiv:doi"]), arxiv_id=own,
        keywords=terms, paper_type=F.lit("preprint"), is_open_access=F.lit(True), open_access_url=F.coalesce(F.get(pdf, 0)["_href"], F.trim(x["id"])),
    )


#: The character entities that bibliography titles use beside numbered ones.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    """Text without tags and with character entities read."""
    for code, letter in _ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(letter))
    return _clean(F.regexp_replace(c, "<[^>]+>", " "))


def ingest_dblp(raw: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """I4: hits, one or many; authors as text, list or object; then the run's years, which an unknown year fails."""
    v = F.try_parse_json("payload")
    one = F.when(_kind(v, "$.result.hits.hit", "OBJECT"), F.array(F.try_variant_get(v, "$.result.hits.hit", "variant")))
    rows = _each(raw, F.coalesce(one, items(v, "$.result.hits.hit")))
    x = F.col("x")
    field = lambda path: unescaped(text(x, path))
    name = lambda a: _author(F.coalesce(unescaped(text(a, "$")), unescaped(text(a, "$.text")), unescaped(text(a, "$['#text']"))))
    people = F.when(_kind(x, "$.info.authors.author", "ARRAY"), items(x, "$.info.authors.author")).otherwise(F.array(F.try_variant_get(x, "$.info.authors.author", "variant")))
    kind = F.lower(F.coalesce(field("$.info.type"), F.lit("")))
    paper_type = F.when(kind.rlike("conference|workshop"), "conference").when(kind.rlike("journal|article"), "article")
    key, year = field("$.info.key"), field("$.info.year")
    out = _papers(
        rows, "dblp", paper_id=F.concat(F.lit("dblp:"), key), title=field("$.info.title"), authors=_named(F.transform(people, name)), year=F.when(year.rlike(r"^\d{1,9}$"), year), venue=F.coalesce(field("$.info.venue"), field("$.info.journal"), field("$.info.booktitle")),
        doi=field("$.info.doi"), paper_type=paper_type, dblp_key=key,
    )
    if intents is None:
        return out
    years = intents.select("run_id", "year_start", "year_end")
    return out.join(years, "run_id", "left").where(F.col("year_start").isNull() | F.coalesce(F.col("year").between(F.col("year_start"), F.col("year_end")), F.lit(False))).drop("year_start", "year_end")


_PUBMED = """PubmedArticle ARRAY<STRUCT<MedlineCitation: STRUCT<PMID: STRING, DateCompleted: STRUCT<Year: STRING>, Article: STRUCT<ArticleTitle: STRING, ArticleDate: ARRAY<STRUCT<Year: STRING>>, Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_Label: STRING, _VALUE: STRING>>>,
 AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, Initials: STRING, CollectiveName: STRING>>>, PublicationTypeList: STRUCT<PublicationType: ARRAY<STRING>>, Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>>>,
 PubmedData: STRUCT<ArticleIdList: STRUCT<ArticleId: ARRAY<STRUCT<_IdType: STRING, _VALUE: STRING>>>>>>"""


def ingest_pubmed(raw: DataFrame, bare_labels: bool = False) -> DataFrame:
    """Articles of article sets; raw_rank is set later by rank_by_idlist.

    A section of the abstract without text leaves nothing, or its label with bare_labels.
    """
    rows = _each(raw.withColumn("f", F.from_xml("payload", _PUBMED)), F.col("f.PubmedArticle"))
    m = F.col("x")["MedlineCitation"]
    a = m["Article"]
    given = lambda p: _clean(p["_VALUE"]).isNotNull() | (_clean(p["_Label"]).isNotNull() & F.lit(bare_labels))
    part = lambda p: F.when(given(p), F.concat_ws(": ", _clean(p["_Label"]), F.coalesce(_clean(p["_VALUE"]), F.lit(""))))
    abstract = F.array_join(F.array_compact(F.transform(a["Abstract"]["AbstractText"], part)), "\n")
    full = lambda p: F.nullif(F.concat_ws(" ", _clean(p["ForeName"]), _clean(p["LastName"])), F.lit(""))
    name = lambda p: _author(F.coalesce(_clean(p["CollectiveName"]), full(p), F.nullif(F.concat_ws(" ", _clean(p["Initials"]), _clean(p["LastName"])), F.lit(""))))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    good = lambda y: F.when(F.trim(y).rlike(r"^(?:1[89]\d\d|20\d\d|2100)$"), F.trim(y))
    year = F.coalesce(good(F.get(a["ArticleDate"], 0)["Year"]), good(date["Year"]), good(m["DateCompleted"]["Year"]), F.nullif(F.regexp_extract(F.coalesce(date["MedlineDate"], F.lit("")), r"((?:18|19|20)\d{2})", 1), F.lit("")))
    kinds = F.transform(F.coalesce(a["PublicationTypeList"]["PublicationType"], _NO_TEXTS()), lambda t: F.lower(_clean(t)))
    holds = lambda word: F.exists(kinds, lambda t: F.coalesce(F.contains(t, F.lit(word)), F.lit(False)))
    paper_type = F.when(holds("review"), "review").when(holds("conference"), "conference").when(F.array_contains(kinds, "journal article"), "article")
    ids = F.filter(F.col("x")["PubmedData"]["ArticleIdList"]["ArticleId"], lambda i: F.lower(i["_IdType"]) == "doi")
    pmid = _clean(m["PMID"])
    return _papers(rows, "pubmed", paper_id=F.concat(F.lit("pubmed:"), pmid), title=_clean(a["ArticleTitle"]), abstract=F.coalesce(abstract, F.lit("")), authors=_named(F.transform(a["AuthorList"]["Author"], name)), year=year, venue=_clean(a["Journal"]["Title"]), doi=_clean(F.get(ids, 0)["_VALUE"]), pmid=pmid, paper_type=paper_type)


def rank_by_idlist(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with raw_rank, the place of their pmid among a search's distinct trimmed ids (run_id, round, idlist)."""
    each = ids.select("run_id", "round", F.posexplode("idlist").alias("pos", "pmid")).withColumn("pmid", F.trim("pmid")).where("pmid <> ''")
    first = each.groupBy("run_id", "round", "pmid").agg(F.min("pos").alias("pos"))
    ranks = first.select("run_id", "round", "pmid", F.row_number().over(Window.partitionBy("run_id", "round").orderBy("pos")).alias("raw_rank"))
    return articles.drop("raw_rank").join(ranks, ["run_id", "round", "pmid"], "left")


def ingest_s2(raw: DataFrame) -> DataFrame:
    """Papers under data, with the ids of other platforms."""
    rows = _each(raw.withColumn("v", F.try_parse_json("payload")), items(F.col("v"), "$.data"))
    x = F.col("x")
    kinds = F.transform(texts(x, "$.publicationTypes"), lambda t: F.lower(t))
    holds = lambda *names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    paper_type = F.when(holds("conference"), "conference").when(holds("review"), "review").when(holds("article", "journalarticle"), "article").when(holds("preprint"), "preprint")
    authors = F.transform(items(x, "$.authors"), lambda a: _author(text(a, "$.name"), own=text(a, "$.authorId")))
    return _papers(
        rows, "semantic_scholar", paper_id=text(x, "$.paperId"), title=text(x, "$.title"), abstract=F.coalesce(text(x, "$.abstract"), F.lit("")), authors=_named(authors), year=whole(x, "$.year"), venue=text(x, "$.venue"), doi=text(x, "$.externalIds.DOI"), arxiv_id=text(x, "$.externalIds.ArXiv"),
        pmid=text(x, "$.externalIds.PubMed"), dblp_key=text(x, "$.externalIds.DBLP"), citation_count=F.greatest(F.coalesce(whole(x, "$.citationCount"), F.lit(0)), F.lit(0)), references=F.array_compact(F.transform(items(x, "$.references"), lambda r: text(r, "$.paperId"))), paper_type=paper_type,
        semantic_scholar_id=text(x, "$.paperId"), is_open_access=F.when(_kind(x, "$.isOpenAccess", "BOOLEAN"), F.try_variant_get(x, "$.isOpenAccess", "boolean")), open_access_url=text(x, "$.openAccessPdf.url"),
    )


def ingest_discoveries(raw: DataFrame) -> DataFrame:
    """I8: web results with title and http(s) link; a score under 0 is unknown."""
    rows = _each(raw.withColumn("v", F.try_parse_json("payload")), items(F.col("v"), "$.results"))
    x = F.col("x")
    number = F.when(_kind(x, "$.score", "BIGINT") | _kind(x, "$.score", "DECIMAL") | _kind(x, "$.score", "DOUBLE"), F.try_variant_get(x, "$.score", "double"))
    out = rows.select(*_RUN, F.lit("tavily").alias("source"), "raw_rank", text(x, "$.title").alias("title"), text(x, "$.url").alias("url"), F.coalesce(text(x, "$.content"), F.lit("")).alias("snippet"), F.when(number >= 0, number).alias("score"))
    return out.where(F.col("title").isNotNull() & F.col("url").rlike("^https?://"))


def unparsed(raw: DataFrame) -> DataFrame:
    """Responses whose payload isn't JSON, which give no records."""
    return raw.where(F.col("payload").isNull() | F.try_parse_json("payload").isNull())


def split_bad(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with id and title, and the others; ranks are those of the response, so bad records keep their places."""
    good = F.col("paper_id").isNotNull() & F.col("title").isNotNull()
    return papers.where(good), papers.where(~good)


_ASSESSMENTS = "assessments ARRAY<STRUCT<paper_id: STRING, relevance_score: DOUBLE, constraint_status: STRING, evidence: ARRAY<STRING>, recommendation_reason: STRING>>"


@F.pandas_udf(StringType())
def _repaired(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if c is None else repair(c))


#: The first character after white space, and the first after a comma and more of it.
_AFTER = re.compile(r"[ \t\r\n]*+(,|.|)(?:(?<=,)[ \t\r\n]*+(.|))?", re.S)


def repair(content: str) -> str:
    """Text of an object in which quotes inside strings, bare control characters and bad escapes are put right.

    A quote ends a string only where a colon, a bracket or the next member follows.
    """
    out, inside, at = [], False, 0
    while at < len(content):
        c = content[at]
        if not inside:
            inside = c == '"'
            out.append(c)
        elif c == "\\":
            nxt = content[at + 1 : at + 2]
            hexes = content[at + 2 : at + 6]
            fine = nxt in tuple('"\\/bfnrt') or nxt == "u" and len(hexes) == 4 and all(h in "0123456789abcdefABCDEF" for h in hexes)
            out.append(c + nxt if fine else "\\\\" + nxt)
            at += 1
        elif c == '"':
            follows = _AFTER.match(content, at + 1)
            ends = follows[1] in ("", ":", "}", "]") or follows[1] == "," and follows[2] in ("", '"', "}", "]")
            inside = not ends
            out.append(c if ends else '\\"')
        else:
            out.append(json.dumps(c)[1:-1] if ord(c) < 32 else c)
        at += 1
    return "".join(out)


def ingest_assessments(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assessments, usage, quarantine) of model responses (run_id, batch, payload).

    The first message may be fenced; only messages that don't parse are repaired and tried again.
    """
    v = F.try_parse_json("payload")
    message = F.trim(text(v, "$.choices[0].message.content"))
    bare = F.coalesce(F.nullif(F.trim(F.regexp_extract(message, r"(?s)^```[^\n]*\n(.*)```", 1)), F.lit("")), message)
    tokens = lambda path: F.greatest(F.coalesce(whole(v, path), F.lit(0)), F.lit(0))
    rows = raw.select("run_id", "batch", "payload", bare.alias("content"), text(v, "$.model").alias("model"), tokens("$.usage.prompt_tokens").alias("prompt_tokens"), tokens("$.usage.completion_tokens").alias("completion_tokens"))
    parsed = lambda df: df.withColumn("p", F.when(F.try_parse_json("content").isNotNull(), F.from_json("content", _ASSESSMENTS)))
    first = parsed(rows)
    good = F.col("p.assessments").isNotNull()
    second = parsed(first.where(~F.coalesce(good, F.lit(False))).drop("p").withColumn("content", _repaired("content")))
    both = first.where(good).unionByName(second.where(good))
    out = both.select("run_id", "batch", F.posexplode("p.assessments").alias("item", "a")).select("run_id", "batch", "item", "a.paper_id", F.col("a.relevance_score").alias("relevance"), F.col("a.constraint_status").alias("status"), "a.evidence", F.col("a.recommendation_reason").alias("reason"))
    valid = F.col("relevance").between(0, 1) & F.col("status").isin("satisfied", "not_satisfied", "uncertain") & F.col("paper_id").isNotNull()
    return out.where(valid), both.select("run_id", "batch", "model", "prompt_tokens", "completion_tokens"), second.where(~F.coalesce(good, F.lit(False))).select("run_id", "batch", "payload")


#: Names by which planners call paper types.
TYPE_ALIASES = {
    "article": "article", "research article": "article", "journal article": "article", "journalarticle": "article", "conference": "conference", "conference paper": "conference",
    "proceedings article": "conference", "preprint": "preprint", "review": "review", "review article": "review", "survey": "review",
}


def _merged(first: Column, second: Column) -> Column:
    all_ = F.filter(F.transform(F.concat(first, second), lambda t: F.trim(t)), lambda t: t != "")
    folded = F.transform(all_, casefold)
    return F.filter(all_, lambda t, i: F.array_position(folded, F.get(folded, i)) == i + 1)


def normalize_intents(raw: DataFrame, requests: DataFrame) -> DataFrame:
    """Planner responses (run_id, payload) and requests (run_id, must, should, exclude, domains, year_start, year_end, target_count).

    must comes from the request alone, other lists from both; a request's years win.
    """
    v = F.try_parse_json("payload")
    aliases = F.create_map(*(F.lit(x) for pair in TYPE_ALIASES.items() for x in pair))
    named = F.transform(texts(v, "$.paper_types"), lambda t: collapse(F.translate(F.lower(t), "_-", "  ")))
    score = F.try_variant_get(v, "$.complexity_score", "double")
    years = lambda path, i: F.coalesce(F.when(_kind(v, "$.year_range", "OBJECT"), whole(v, f"$.year_range.{path}")), F.when(_kind(v, "$.year_range", "ARRAY"), whole(v, f"$.year_range[{i}]"))).cast("int")
    sub = F.transform(F.slice(items(v, "$.subqueries"), 1, 3), lambda s: F.struct(text(s, "$.query").alias("query"), F.coalesce(text(s, "$.language"), F.lit("en")).alias("language"), text(s, "$.purpose").alias("purpose")))
    lists = {n: texts(v, f"$.{n}") for n in ("methods", "tasks", "datasets", "authors", "institutions", "venues")}
    p = raw.select(
        "run_id", text(v, "$.normalized_query").alias("query"), texts(v, "$.research_topics").alias("topics"), *(c.alias(n) for n, c in lists.items()), F.array_distinct(F.transform(named, lambda t: F.coalesce(F.try_element_at(aliases, t), t))).alias("paper_types"),
        F.when((score > 1) & (score <= 5), score / 5).otherwise(score).alias("complexity"), years("start", 0).alias("y1"), years("end", 1).alias("y2"), texts(v, "$.should_include").alias("s"), texts(v, "$.exclude").alias("e"), texts(v, "$.domains").alias("d"), sub.alias("subqueries"),
    )
    r = requests.select("run_id", "must", "should", F.col("exclude").alias("x"), "domains", "year_start", "year_end", "target_count")
    rows = p.join(r, "run_id")
    own = F.col("year_start").isNotNull() & F.col("year_end").isNotNull()
    return rows.select(
        "run_id", "query", "topics", *lists, "paper_types", "complexity", F.when(own, F.col("year_start")).otherwise(F.col("y1")).alias("year_start"), F.when(own, F.col("year_end")).otherwise(F.col("y2")).alias("year_end"), "must",
        _merged(F.col("s"), F.col("should")).alias("should"), _merged(F.col("e"), F.col("x")).alias("exclude"), _merged(F.col("d"), F.col("domains")).alias("domains"), "subqueries", "target_count",
    )
