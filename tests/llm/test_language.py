"""Language by the field: exact marginals and gradients, held-out accuracy, word labels of switching texts, odd rows."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folium.llm.language import SEGMENT, Languages, _sequence_gradient, held_out, languages, learn, word_features


def field(kinds, rng):
    return Languages([str(k) for k in range(kinds)], np.zeros((1, kinds)), rng.normal(size=(kinds, kinds)), rng.normal(size=kinds), np.zeros(1, int), np.zeros((1, kinds)))


def plain(e, moves, start):
    """Forward-backward one word after another."""
    t, alpha, beta = np.exp(moves), [e[0] * np.exp(start)], [np.ones(e.shape[1])]
    for x in e[1:]:
        v = (alpha[-1] / alpha[-1].sum()) @ t * x
        alpha.append(v / v.sum())
    for x in e[:0:-1]:
        v = t @ (x * beta[-1])
        beta.append(v / v.sum())
    g = np.array(alpha) * np.array(beta[::-1])
    return g / g.sum(1, keepdims=True)


@pytest.mark.parametrize("kinds", [1, 2, 5])
def test_marginals_of_segments(kinds):
    rng = np.random.default_rng(kinds)
    sizes = [0, 1, 2, SEGMENT - 1, SEGMENT, SEGMENT + 1, 0, 2 * SEGMENT, 5, 1000, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, model = np.exp(-40 * rng.random((first[-1], kinds))), field(kinds, rng)
    got = model.marginals(e, first)
    for a, b in itertools.pairwise(first):
        assert a == b or np.allclose(got[a:b], plain(e[a:b], model.moves, model.start), atol=1e-10)
    assert model.marginals(e[:0], np.zeros(4, int)).shape == (0, kinds)


def test_gradient_by_all_paths():
    rng = np.random.default_rng(2)
    e, moves, start = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    words, pairs, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(start[path[0]] + sum(e[0, i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for i, k in enumerate(path):
            words[i, k] += p
        for a, b in itertools.pairwise(path):
            pairs[a, b] += p
    gamma, expected = _sequence_gradient(e, moves, start, np.ones((1, 4), bool))
    assert np.allclose(gamma[0], words / total) and np.allclose(expected, pairs / total)
    longer = np.concatenate([e, rng.normal(size=(1, 3, 3))], 1)
    gamma, expected = _sequence_gradient(longer, moves, start, np.arange(7)[None] < 4)
    assert np.allclose(gamma[0, :4], words / total) and np.allclose(expected, pairs / total)


def test_features_depend_on_the_word_alone():
    text = np.frombuffer(b"x abc le abc \xc3\xa9t a", np.uint8)
    starts, ends = np.array([0, 2, 6, 9, 13, 17]), np.array([1, 5, 8, 12, 16, 18])
    features, first = word_features(text, starts, ends)
    one = [sorted(features[a:b]) for a, b in itertools.pairwise(first)]
    assert one[1] == one[3] and one[0] != one[5] and all(len(x) == 8 + 2 * (e - s) for x, s, e in zip(one, starts, ends, strict=True))
    alone, _ = word_features(text[2:5], np.array([0]), np.array([3]))
    assert sorted(alone) == one[1]


@pytest.fixture(scope="module")
def learnt(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return documents, learn(documents)


def test_held_out_accuracy(learnt):
    documents, model = learnt
    rows = languages(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 300 and (rows.lang_pred == rows.lang).mean() >= 0.99 and rows.score.between(0, 1).all()
    assert (rows.score > 0.9).mean() > 0.9


def test_words_of_switching_texts(spark, learnt):
    """Stretches of 12 words of held-out documents, put together: nine in ten words and more get their language."""
    documents, model = learnt
    rng = np.random.default_rng(1)
    texts = documents.where(held_out()).where("n_chars > 500").select("text", "lang").orderBy("doc_id").limit(150).collect()
    rows, want = [], []
    for i in range(100):
        words, of = [], []
        for _ in range(6):
            r = texts[rng.integers(len(texts))]
            clean = [w for w in r["text"].replace("!!", "").split() if w.strip(".,").isalpha()]
            at = int(rng.integers(max(1, len(clean) - 12)))
            words += clean[at : at + 12]
            of += [r["lang"]] * len(clean[at : at + 12])
        rows.append((i, " ".join(words)))
        want.append(of)
    right = total = switches = 0
    for r in languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got = [s["lang"] for s in r["stretches"] for _ in range(s["n_words"])]
        assert [s["first"] for s in r["stretches"]] == [0, *itertools.accumulate(s["n_words"] for s in r["stretches"])][:-1]
        assert len(got) == len(want[r["doc_id"]])
        right += sum(a == b for a, b in zip(got, want[r["doc_id"]], strict=True))
        total += len(got)
        switches += len(r["stretches"]) > 1
    assert right / total > 0.93 and switches > 70


def test_same_results_however_dealt(learnt):
    documents, model = learnt
    one, two = (languages(d, model).drop("stretches").toPandas().sort_values("doc_id").reset_index(drop=True) for d in (documents.coalesce(1), documents.repartition(7)))
    assert one.equals(two)
    again = learn(documents.repartition(5))
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.moves, again.moves)


def test_odd_rows(spark, learnt):
    documents, model = learnt
    long = " ".join(r["text"] for r in documents.where("lang = 'fr'").select("text").limit(100).collect()) * 5
    rows = [(1, None), (2, ""), (3, "12 34 !! 5"), (4, "— 。 ☃ 9"), (None, "the and of the with from"), (5, long), (6, "the with the from 7 8 9"), (6, "the with the from 7 8 9"), (7, "жук 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("xx"), "score": F.lit("s"), "a.b": F.lit(1)})
    out = {(r["doc_id"], i): r for i, r in enumerate(languages(df, model).collect())}
    got = {k[0]: (r["lang_pred"], r["score"]) for k, r in out.items()}
    assert len(out) == 9 and all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[None][0] == "en" and got[5][0] == "fr" and got[6][0] == "en" and got[7][0] in model.names
    assert pa.array([r["held_out"] for r in out.values() if r["doc_id"] is None]).to_pylist() == [False]


def test_nothing_or_little_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([(1, "abc", None), (None, "def", "en"), (3, "12", "en"), (4, None, "en")], schema)
    model = learn(none)
    assert model.names == [] and {r["lang_pred"] for r in languages(none, model).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc def", "en") for i in range(9)], schema)
    assert {(r["lang_pred"], r["score"]) for r in languages(one, learn(one)).collect()} == {("en", 1.0)}
    assert languages(one.limit(0), learn(one.limit(0))).collect() == []


def test_rare_languages_are_learnt(spark):
    rows = [(i, "alpha beta gamma delta " * 5, "aa") for i in range(3000)] + [(3000 + i, "zwei drei vier sechs " * 5, "bb") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(df, 20).names == ["aa", "bb"]
    out = languages(spark.createDataFrame([(1, "vier sechs zwei"), (2, "beta gamma beta")], "doc_id long, text string"), learn(df, 20)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in out} == {1: "bb", 2: "aa"}
