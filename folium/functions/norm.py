"""Normal forms of texts and identifiers.

Case folding is done by lower() and the few letters whose folded form differs, found by rule when this is imported;
only compatibility composition (NFKC) has no built-in function and is one Arrow-batched UDF, meant for titles, names and
identifiers at intake rather than for long texts.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_LOW = [chr(i) for i in range(128, 0x1E943) if not 0xD800 <= i < 0xE000 and chr(i).lower() == chr(i) != chr(i).casefold()]


def _class(letters) -> str:
    """A character class of the letters, by their ranges."""
    codes, spans = sorted(map(ord, letters)), []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def casefold(c) -> Column:
    """Full case folding; texts without unusual letters cost one lower() and one scan."""
    low = F.lower(_col(c))
    table = F.create_map(*(F.lit(x) for c in _LOW for x in (c, c.casefold())))
    rare = F.array_join(F.transform(F.split(low, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    common = F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    rest = [x for x in _LOW if x not in "ßς"]
    maybe = low.rlike(f"[\\x{{{min(map(ord, rest)):x}}}-\\x{{10ffff}}]")  # a cheap test that spares most texts the exact one
    return F.when(maybe & low.rlike(_class(rest)), rare).otherwise(common)


@arrow_udf(StringType())
def nfkc(values: pa.Array) -> pa.Array:
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_strong(c) -> Column:
    """NFKC, folded case, single spaces."""
    return collapse(casefold(nfkc(_col(c))))


def norm_weak(c) -> Column:
    """Folded case, single spaces."""
    return collapse(casefold(c))


def norm_token(c) -> Column:
    """NFKC, folded case, letters and digits only, in words (N1); null if there is none."""
    return F.nullif(F.array_join(F.regexp_extract_all(casefold(nfkc(_col(c))), F.lit(r"(?U)([^\W_]+)")), " "), F.lit(""))


def _stripped(c, prefixes: str) -> Column:
    low = F.trim(F.lower(_col(c)))
    return F.nullif(F.trim(F.regexp_replace(low, f"^(?:{prefixes})", "")), F.lit(""))


def norm_doi(c) -> Column:
    """N2."""
    return F.nullif(F.rtrim(_stripped(c, r"https?://(?:dx\.)?doi\.org/|doi:"), F.lit(" .;,:)]}")), F.lit(""))


def norm_arxiv(c) -> Column:
    """N3."""
    bare = F.substring_index(_stripped(c, r"https?://arxiv\.org/(?:abs|pdf)/|arxiv:"), "?", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", ""), F.lit(""))


def arxiv_from_doi(c) -> Column:
    """The arXiv id that a registered arXiv DOI stands for."""
    return F.nullif(F.regexp_extract(norm_doi(c), r"^10\.48550/arxiv\.([0-9]{4}\.[0-9]{4,5})(?:v\d+)?$", 1), F.lit(""))


def norm_pmid(c) -> Column:
    """N4."""
    bare = F.btrim(_stripped(c, r"https?://pubmed\.ncbi\.nlm\.nih\.gov/|pmid:"), F.lit("/ "))
    return F.when(bare.rlike(r"^\d+$"), bare)


def norm_source_id(c, scheme: str) -> Column:
    """A platform's own id; schemes openalex, semantic_scholar, dblp, internal."""
    if scheme == "openalex":
        return F.nullif(F.btrim(_stripped(c, r"https?://openalex\.org/"), F.lit("/")), F.lit(""))
    if scheme == "semantic_scholar":
        bare = F.btrim(_stripped(c, r"https://www\.semanticscholar\.org/paper/|https://api\.semanticscholar\.org/graph/v1/paper/"), F.lit("/"))
        return F.nullif(F.substring_index(bare, "/", -1), F.lit(""))
    if scheme == "dblp":
        return F.nullif(F.regexp_replace(_stripped(c, r"https?://dblp\.org/rec/"), r"\.html$", ""), F.lit(""))
    return F.nullif(F.trim(F.lower(_col(c))), F.lit(""))


def _known(*values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*values))))


SCHEMES = ("doi", "arxiv_id", "pmid", "openalex_id", "semantic_scholar_id", "dblp_key")


def identifier_sets(df: DataFrame) -> DataFrame:
    """Df with ids, a map from each scheme to the set of values that it can be compared by."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    sets = {
        "doi": _known(norm_doi(have("doi"))), "arxiv_id": _known(norm_arxiv(have("arxiv_id")), arxiv_from_doi(have("doi"))), "pmid": _known(norm_pmid(have("pmid"))),
        "openalex_id": _known(norm_source_id(have("openalex_id"), "openalex")), "semantic_scholar_id": _known(norm_source_id(have("semantic_scholar_id"), "semantic_scholar")), "dblp_key": _known(norm_source_id(have("dblp_key"), "dblp")),
    }
    return df.withColumn("ids", F.create_map(*(x for k, v in sets.items() for x in (F.lit(k), v))))


def compare_ids(pairs: DataFrame, left: str = "left_ids", right: str = "right_ids", left_doi: str = "left_doi", right_doi: str = "right_doi") -> DataFrame:
    """Pairs with same (true, false or null) and evidence, by the first scheme that both sides have."""
    both = lambda s: (F.size(F.col(left)[s]) > 0) & (F.size(F.col(right)[s]) > 0)
    same, evidence = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    alias = arxiv_from_doi(left_doi).isNotNull() | arxiv_from_doi(right_doi).isNotNull()
    for s in reversed(SCHEMES):
        match = F.arrays_overlap(F.col(left)[s], F.col(right)[s])
        named = F.when(match & alias, F.lit("arxiv_doi_alias")).otherwise(F.lit(s)) if s == "arxiv_id" else F.lit(s)
        same, evidence = F.when(both(s), match).otherwise(same), F.when(both(s), named).otherwise(evidence)
    return pairs.withColumns({"same": same, "evidence": evidence})


def _joined(values) -> Column:
    return F.array_join(F.filter(F.transform(_col(values), collapse), lambda x: x != ""), ", ")


def build_texts(papers: DataFrame, abstract_points: int = 12000) -> DataFrame:
    """Papers with embedding_text, reranker_text and text_error ('blank title', the texts then null).

    papers needs title, keywords (an array), abstract, venue and year; only the embedding text's abstract is cut.
    """
    text = lambda c: collapse(F.coalesce(F.col(c).cast("string"), F.lit("")))
    unknown = lambda c: F.coalesce(F.nullif(text(c), F.lit("")), F.lit("Unknown"))
    title, abstract, keywords = text("title"), text("abstract"), F.coalesce(_joined("keywords"), F.lit(""))
    lines = (("Title: ", title), ("Keywords: ", keywords), ("Abstract: ", F.substring(abstract, 1, abstract_points)), ("Venue: ", unknown("venue")), ("Year: ", unknown("year")))
    embedding = F.concat_ws("\n", *(F.concat(F.lit(label), value) for label, value in lines))
    reranker = F.when(abstract == "", title).otherwise(F.concat(title, F.lit("\n"), abstract))
    blank = title == ""
    return papers.withColumns({"embedding_text": F.when(~blank, embedding), "reranker_text": F.when(~blank, reranker), "text_error": F.when(blank, F.lit("blank title"))})


def query_text(topic, **sections) -> Column:
    """The text of a query; sections are columns of arrays, and those without values are left out."""
    named = {"methods": "Required methods", "datasets": "Required datasets", "tasks": "Tasks", "must": "Must include", "should": "Should include", "exclude": "Exclude"}
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Research topic", collapse(_col(topic))), *(line(named[k], _joined(sections[k])) for k in named if k in sections))


def text_hash(text, model: str, revision: str | None = None, builder: str = "v1") -> Column:
    """N8."""
    head = f"{model.strip()}\0{revision or ''}\0{builder}\0"
    return F.sha2(F.concat(F.lit(head), _col(text)).cast("binary"), 256)


def first_forms(values: Column) -> Column:
    """Values that differ but for case, each by its first form, in order."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def split_terms(c, cap: int | None = None) -> Column:
    """N9."""
    parts = F.filter(F.transform(F.split(_col(c), "[,，\n]"), lambda x: F.trim(x)), lambda x: x != "")
    terms = first_forms(parts)
    return F.slice(terms, 1, cap) if cap else terms


def query_language(c) -> Column:
    """N10."""
    han, latin = _col(c).rlike(r"[\x{4e00}-\x{9fff}]"), _col(c).rlike("[A-Za-z]")
    return F.when(han & latin, "mixed").when(han, "zh").otherwise("en")


def doi_url(c) -> Column:
    """A link to a DOI, null where it isn't one."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(_col(c)), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", ""))
    coded = F.url_encode(bare)
    for code, letter in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(letter))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), F.concat(F.lit("https://doi.org/"), coded))


def pdf_url(c) -> Column:
    """The URL if it is a http(s) link whose path names a PDF, else null."""
    url = F.trim(_col(c))
    path = F.lower(F.try_url_decode(F.replace(F.regexp_extract(url, r"^[^:]+://[^/?#]+([^?#]*)", 1), F.lit("+"), F.lit("%2B"))))
    return F.when(url.rlike(r"(?i)^https?://[^/\s]+") & (path.endswith(".pdf") | path.contains("/pdf/")), url)
