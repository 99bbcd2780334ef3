"""Term search against a plain count, and the pairs that it makes."""

import random

from folium.operators import ranking


def brute(queries, corpus, k):
    out = set()
    for qid, text in queries:
        terms = {t for t in text.lower().split() if len(t) > 1}
        scored = sorted((-sum(t in x for t in terms) / len(terms), i) for i, x in corpus if any(t in x for t in terms)) if terms else []
        out |= {(qid, i, round(-s, 9), r + 1) for r, (s, i) in enumerate(scored[:k])}
    return out


def rows_of(df):
    return {(r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in df.collect()}


def test_equals_a_plain_count_and_prunes(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(300)]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(2000)]
    queries = [(q, " ".join([*rng.choices(words, k=rng.randint(1, 4)), *rng.choices(["ab", "a", "zz", "cd e", "de"], k=3)])) for q in range(40)] + [(90, ""), (91, "a b"), (92, "zzz")]
    made = []
    real = ranking._candidates
    monkeypatch.setattr(ranking, "_candidates", lambda *a: (lambda df: made.append(df.count()) or df)(real(*a)))
    q, c = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "id long, search_text string")
    assert rows_of(ranking.term_search(q, c, 5)) == brute(queries, corpus, 5)
    every = sum(any(t in x for t in {t for t in text.split() if len(t) > 1}) for _, text in queries for _, x in corpus)
    assert len(made) == 3 and sum(made) < every / 3, (made, every)


def test_texts_that_hold_every_term_end_the_search(spark, monkeypatch):
    """Short terms that stand in nearly every text: pairs stay a small multiple of k x queries."""
    corpus = [(i, "the of and there" if i % 50 else "none") for i in range(5000)]
    queries = [(q, "the of an") for q in range(30)]
    made = []
    real = ranking._candidates
    monkeypatch.setattr(ranking, "_candidates", lambda *a: (lambda df: made.append(df.count()) or df)(real(*a)))
    q, c = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "id long, search_text string")
    got = rows_of(ranking.term_search(q, c, 10))
    assert got == brute(queries, corpus, 10) and sum(made) <= 5 * 10 * 30


def test_odd_rows(spark):
    corpus = spark.createDataFrame([(1, None), (2, ""), (None, "ab"), (3, "ab ab"), (3, "ab")], "id long, search_text string")
    queries = spark.createDataFrame([(1, "AB  ab"), (2, None), (3, "")], "query_id long, text string")
    got = ranking.term_search(queries, corpus.where("id is not null"), 3)
    assert rows_of(got) == {(1, 3, 1.0, 1)}
    assert ranking.term_search(queries, corpus.limit(0), 3).count() == 0 and ranking.term_search(queries.limit(0), corpus, 3).count() == 0


def test_a_text_is_one_row_of_postings(spark, monkeypatch):
    """Two-letter terms that stand in many words of a text: rows grow with texts, not with texts times terms."""
    corpus = [(i, "the other weather there then") for i in range(200)]
    kept, real = {}, ranking.saved
    monkeypatch.setattr(ranking, "saved", lambda df, name: kept.setdefault(name, real(df, name)))
    q, c = spark.createDataFrame([(1, "th he er the zz")], "query_id long, text string"), spark.createDataFrame(corpus, "id long, search_text string")
    assert rows_of(ranking.term_search(q, c, 2)) == {(1, 0, 0.8, 1), (1, 1, 0.8, 2)} and kept["postings"].count() == 200
