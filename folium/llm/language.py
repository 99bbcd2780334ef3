"""Language of texts by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of one to three bytes, its runs of two and three bytes, itself, and where
a lexicon knows it, the language that it is commonest in and how clearly so. Weights, the start and the transitions between
languages are learnt together; forward-backward gives every word of a whole text the probability of each language, so that
a text that switches between languages is told apart word by word. A document's language is the one with the greatest sum
of probabilities over its words of letters, and its score is that sum's share.

The field is learnt from the languages of a bounded sample of documents: FIT_DOCUMENTS of each language in expectation,
drawn by hash, and never more than twice as many in all. Half of them give the lexicon (words of at least two of them),
the other half (of a language with fewer documents than that, all give both) stretches of words from all over their texts, of which several, of equal or different languages, are put
together to one training sequence: so transitions learn that languages stay, and that they change.

Long texts are cut in segments whose transfer matrices are multiplied for all segments at once; what enters and leaves each
segment follows from these, and the segments are then walked together. That is exact, and linear in the number of words.

Cases: a null text, or one without a letter, is `und` with score 0, as is every text where nothing could be learnt; words
of digits count for nothing; documents of null language or doc_id are predicted but not learnt from; repeated rows each
count and each give a row; other columns are never read. Scores are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.text import mix, pieces, word_hashes, word_spans

#: Documents of each language that a fit uses, in expectation.
FIT_DOCUMENTS = 500
STRETCH, STRETCHES = 8, 4  # words of a training stretch, stretches of a document
FEATURES = 1 << 16
LEXICON = 1 << 17
SEGMENT = 64
PIECE = 4 << 20
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id"):
    """True for the third of documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words data[start:end], and where each word's begin; a word has at least ten."""
    n, size = len(starts), ends - starts
    # ^word$ of all words behind one another
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.full(begin[-1], 36, np.uint64)
    text[begin[:-1]] = 94
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size + 2)
    letter = (inside > 0) & (inside <= np.repeat(size, size + 2))
    text[letter] = data[(np.repeat(starts, size + 2) + inside - 1)[letter]]
    pair = text[:-1] * np.uint64(257) + text[1:] if len(text) else text
    three = pair[:-1] * np.uint64(257) + text[2:] if len(text) else text
    doubles, triples = size + 1, size
    width = 7 + doubles + triples
    first = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(first[-1], np.uint64)
    salt = lambda x, k: mix(x + np.uint64(k << 40))
    at = first[:-1]
    b = begin[:-1]
    last = np.maximum(begin[1:] - 4, b)  # the last three before $, or fewer
    tail = text[begin[1:] - 2] if n else text
    out[at], out[at + 1], out[at + 2] = salt(text[b + 1], 1), salt(pair[b + 1], 2), salt(three[b], 3)
    out[at + 3], out[at + 4], out[at + 5] = salt(tail, 4), salt(pair[begin[1:] - 3], 5), salt(three[last], 6)
    out[at + 6] = salt(word_hashes(data, starts, ends), 7)
    for grams, count, skip, k in ((pair, doubles, 7, 8), (three, triples, 7 + doubles, 9)):
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(at + skip, count) + step] = salt(grams[np.repeat(b, count) + step], k)
    return (out % np.uint64(FEATURES)).astype(np.int32), first


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % LEXICON


@dataclass
class Languages:
    """weights[feature, language], moves[from, to], start[language], and a class of lexicon evidence for each bucket of words."""

    names: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    known: np.ndarray  # bucket -> class; class 0 is an unknown word
    evidence: np.ndarray  # class, language

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """exp of each word's scores, at most 1; distinct words are looked at once."""
        hashes = word_hashes(data, starts, ends)
        _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        features, first = word_features(data, starts[at], ends[at])
        z = np.add.reduceat(self.weights[features], first[:-1], axis=0) + self.evidence[self.known[_bucket(hashes[at])]]
        return np.exp(np.maximum(z - z.max(1, keepdims=True), -40))[back]

    def marginals(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of each language at each word, of texts whose words begin at first."""
        count = np.diff(first)
        own = -(-count // SEGMENT)
        start_of = np.cumsum(own) - own  # the number of each text's first segment
        rank = np.arange(own.sum()) - np.repeat(start_of, own)
        begin = np.repeat(first[:-1], own) + rank * SEGMENT
        size = np.minimum(np.repeat(first[1:], own) - begin, SEGMENT)
        t = np.exp(self.moves - self.moves.max())
        e = e.copy()
        heads = first[:-1][count > 0]
        e[heads] *= np.exp(self.start - self.start.max())  # a text's first word has no transition before it
        n, kinds = len(begin), len(self.names)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        opening = (rank == 0)[order]
        live = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than k come first
        through = np.broadcast_to(np.eye(kinds), (n, kinds, kinds)).copy()
        for k in range(SEGMENT):
            c = live[k]
            if not c:
                break
            step = (through[:c].reshape(-1, kinds) @ t).reshape(-1, kinds, kinds)
            if not k:
                step[opening[:c]] = through[:c][opening[:c]]
            step *= e[begin[:c] + k][:, None, :]
            if k % 4 == 3:  # four factors stay far above the least number
                step /= (step.reshape(-1, kinds * kinds) @ np.ones(kinds * kinds))[:, None, None]
            through[:c] = step
        into, out = np.ones((n, kinds)), np.ones((n, kinds))
        full = np.argsort(-own, kind="stable")
        for r in range(int(own.max(initial=0)) - 1):
            docs = full[: np.searchsorted(-own[full], -(r + 1), "left")]  # texts with a segment after their r-th
            a = place[start_of[docs] + r]
            v = np.einsum("ni,nij->nj", into[a], through[a])
            into[place[start_of[docs] + r + 1]] = v / v.sum(1, keepdims=True)
            b = place[start_of[docs] + own[docs] - 1 - r]
            v = np.einsum("nij,nj->ni", through[b], out[b])
            out[place[start_of[docs] + own[docs] - 2 - r]] = v / v.sum(1, keepdims=True)
        alpha, one = np.empty_like(e), np.ones(kinds)
        for k in range(SEGMENT):
            c = live[k]
            if not c:
                break
            v = into[:c] @ t
            if not k:
                v[opening[:c]] = into[:c][opening[:c]]
            v *= e[begin[:c] + k]
            v /= (v @ one)[:, None]
            into[:c] = v
            alpha[begin[:c] + k] = v
        for k in range(SEGMENT - 1, -1, -1):
            c = live[k]
            if not c:
                continue
            at = begin[:c] + k
            alpha[at] *= out[:c]
            v = (e[at] * out[:c]) @ t.T
            out[:c] = v / (v @ one)[:, None]
        return alpha / (alpha @ one)[:, None]


def _sequence_gradient(e: np.ndarray, moves: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of words (batch, length, language) and expected transitions of a batch of sequences of log scores e."""
    n, size, kinds = e.shape
    p, t = np.exp(e - e.max(2, keepdims=True)), np.exp(moves)
    alpha, beta = np.empty_like(p), np.ones_like(p)
    alpha[:, 0] = p[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for k in range(1, size):
        a = (alpha[:, k - 1] @ t) * p[:, k]
        alpha[:, k] = np.where(mask[:, k, None], a / a.sum(1, keepdims=True), alpha[:, k - 1])
    expected = np.zeros_like(moves)
    for k in range(size - 1, 0, -1):
        right = p[:, k] * beta[:, k]
        pair = alpha[:, k - 1, :, None] * t * right[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        expected += (pair * mask[:, k, None, None]).sum(0)
        b = right @ t.T
        beta[:, k - 1] = np.where(mask[:, k, None], b / b.sum(1, keepdims=True), beta[:, k])
    gamma = alpha * beta
    return gamma / gamma.sum(2, keepdims=True), expected


def fit(names: list[str], label: np.ndarray, features: list[list[np.ndarray]], bucket: list[np.ndarray], lexicon: np.ndarray, epochs: int = 4, rate: float = 0.2, decay: float = 1e-4, seed: int = 11) -> Languages:
    """Adagrad on the log likelihood of sequences of three stretches each; lexicon[bucket, language] counts documents."""
    kinds, rng = len(names), np.random.default_rng(seed)
    total = lexicon.sum(1)
    share = np.divide(lexicon.max(1), total, out=np.zeros(len(lexicon)), where=total > 0)
    grade = np.searchsorted([0.5, 0.8, 0.95], share)
    known = np.where(total > 0, 1 + lexicon.argmax(1) * 4 + grade, 0).astype(np.int32)
    model = Languages(names, np.zeros((FEATURES, kinds)), np.zeros((kinds, kinds)), np.zeros(kinds), known, np.zeros((1 + 4 * kinds, kinds)))
    w2, v2, t2, s2 = (np.full_like(x, 1e-6) for x in (model.weights, model.evidence, model.moves, model.start))
    n = len(label)
    for _ in range(epochs if n and kinds > 1 else 0):
        # A sequence is a stretch, then another of its language or of any, then one of any; languages are equally likely.
        present = np.unique(label)
        of = {k: np.flatnonzero(label == k) for k in present.tolist()}
        other = lambda: int(rng.choice(of[int(rng.choice(present))]))
        chains = [(i, int(rng.choice(of[int(label[i])])) if rng.random() < 0.5 else other(), other()) for i in rng.permutation(n).tolist()]
        for lo in range(0, n, 64):
            batch = [[(label[i], f, b) for i in chain for f, b in zip(features[i], bucket[i].tolist(), strict=True)] for chain in chains[lo : lo + 64]]
            size = max(map(len, batch))
            mask = np.arange(size)[None] < np.array([len(s) for s in batch])[:, None]
            y = np.zeros(mask.shape, np.int64)
            y[mask] = [word[0] for s in batch for word in s]
            flat = [word[1] for s in batch for word in s]
            width = np.array([len(f) for f in flat])
            own, begin = np.repeat(np.arange(len(flat)), width), np.cumsum(width) - width
            f, v = np.concatenate(flat), known[np.array([word[2] for s in batch for word in s])]
            e = np.zeros((*mask.shape, kinds))
            e[mask] = model.evidence[v] + np.add.reduceat(model.weights[f], begin, axis=0)
            p, expected = _sequence_gradient(e, model.moves, model.start, mask)
            p[np.arange(len(batch))[:, None], np.arange(size)[None], y] -= 1
            g = p[mask]
            moved = mask[:, 1:]
            np.subtract.at(expected, (y[:, :-1][moved], y[:, 1:][moved]), 1)
            by = np.argsort(f, kind="stable")
            rows, cut = np.unique(f[by], return_index=True)
            gw = np.add.reduceat(g[own[by]], cut, axis=0)
            gw += decay * model.weights[rows]
            w2[rows] += gw**2
            model.weights[rows] -= rate * gw / np.sqrt(w2[rows])
            gv = np.zeros_like(model.evidence)
            np.add.at(gv, v, g)
            gs = p[:, 0].sum(0)
            for x, sums, grad in ((model.evidence, v2, gv), (model.moves, t2, expected), (model.start, s2, gs)):
                sums += grad**2
                x -= rate * grad / np.sqrt(sums)
    return model


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document (key, lang, text) its distinct words' buckets, and stretches of words with their features."""
    for batch in batches:
        for row, data, offsets in pieces(batch["text"], lower=True):
            starts, ends, first = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            rows = []
            for i in range(len(offsets) - 1):
                a, b = int(first[i]), int(first[i + 1])
                one = {"key": batch["key"][row + i].as_py(), "lang": batch["lang"][row + i].as_py()}
                rows.append({**one, "at": -1, "buckets": np.unique(_bucket(hashes[a:b])), "features": [], "sizes": []})
                for at, x in enumerate(np.unique(np.linspace(a, max(a, b - STRETCH), STRETCHES).astype(int)).tolist()):
                    y = min(x + STRETCH, b)
                    if y > x:
                        lo = starts[x]
                        f, begin = word_features(data[lo : ends[y - 1]], starts[x:y] - lo, ends[x:y] - lo)
                        rows.append({**one, "at": at, "buckets": _bucket(hashes[x:y]), "features": f, "sizes": np.diff(begin)})
            kinds = {"key": pa.int64(), "lang": pa.string(), "at": pa.int32(), "buckets": pa.list_(pa.int32()), "features": pa.list_(pa.int32()), "sizes": pa.list_(pa.int32())}
            yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))


def learn(documents: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Languages:
    """A field learnt from documents (doc_id, text, lang) that aren't held out; every language among them is a value."""
    usable = documents.where("doc_id is not null and lang is not null").where(~held_out() & F.rlike("text", F.lit("\\p{L}")))
    usable = usable.select(F.xxhash64("doc_id", "text").alias("key"), "lang", "text")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row for each language
    names = sorted(counts)
    lexicon = np.zeros((LEXICON, len(names)))
    label, features, bucket = [], [], []
    if names:
        share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, fit_documents / n))))
        drawn = usable.where(F.pmod("key", F.lit(1 << 30)) / (1 << 30) < F.element_at(share, F.col("lang")))
        drawn = drawn.orderBy(F.hash("key"), "key", "lang").limit(2 * fit_documents * len(names))
        rows = drawn.mapInArrow(_examples, "key long, lang string, at int, buckets array<int>, features array<int>, sizes array<int>").toArrow()
        rows = rows.sort_by([("key", "ascending"), ("lang", "ascending"), ("at", "ascending")]).to_pandas()
        for r in rows.itertuples():
            k = names.index(r.lang)
            few = counts[r.lang] < fit_documents
            if r.at < 0 and (few or r.key % 2):
                lexicon[np.asarray(r.buckets, np.int64), k] += 1
            elif r.at >= 0 and (few or not r.key % 2):
                label.append(k)
                features.append(np.split(np.asarray(r.features), np.cumsum(r.sizes)[:-1]))
                bucket.append(np.asarray(r.buckets, np.int64))
    else:
        return Languages([], np.zeros((FEATURES, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(LEXICON, np.int32), np.zeros((1, 0)))
    lexicon[lexicon.sum(1) < 2] = 0
    return fit(names, np.array(label, np.int64), features, bucket, lexicon)


def languages(documents: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, stretches): stretches (lang, first, n_words) are the runs of words that are
    likeliest of one language. One pass, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES and LEXICON bound it, by language
    stretch = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("n_words", pa.int64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        names = np.array([*field.names, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            lang, score, runs = np.full(n, len(field.names)), np.zeros(n), [[] for _ in range(n)]
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False))
            for row, data, offsets in pieces(batch["text"], lower=True, most=PIECE) if field.names else ():
                starts, ends, first = word_spans(data, offsets)
                if not len(starts):
                    continue
                p = field.marginals(field.emissions(data, starts, ends), first)
                digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
                counted = (digits[ends] - digits[starts]) < ends - starts
                some = np.flatnonzero((np.diff(first) > 0) & letters[row : row + len(offsets) - 1])
                if not len(some):
                    continue
                docs = np.flatnonzero(np.diff(first) > 0)
                sums = np.add.reduceat(p * counted[:, None], first[docs], axis=0)
                best = sums.argmax(1)
                likely = sums.max(1) / np.maximum(sums.sum(1), 1e-300)
                spoken = np.isin(docs, some)
                lang[row + docs[spoken]], score[row + docs[spoken]] = best[spoken], np.round(likely[spoken], 6)
                word = p.argmax(1)
                change = np.ones(len(word), bool)
                change[1:] = word[1:] != word[:-1]
                change[first[docs]] = True
                at = np.flatnonzero(change)
                size, of = np.diff(np.append(at, len(word))), np.searchsorted(first, at, "right") - 1
                for d, k, a, m in zip(of.tolist(), word[at].tolist(), (at - first[of]).tolist(), size.tolist(), strict=True):
                    runs[row + d].append({"lang": field.names[k], "first": a, "n_words": m})
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(names[lang], pa.string()), pa.array(score), pa.array(runs, pa.list_(stretch))], ["doc_id", "held_out", "lang_pred", "score", "stretches"])

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, stretches array<struct<lang: string, first: long, n_words: long>>")
