"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns give the base spans of four kinds. The field reads every stretch of tokens (runs without white space) that
all hold a digit or an @, as every part of the four kinds does, by features of the word shapes of each token and of two
on each side; it is trained on a small labelled table by forward-backward gradients and decoded by Viterbi for many
stretches at once in numpy. A decoded span is added unless it touches a base span; base spans always stay. All work is
linear in a text's length but for a sort of its spans.

Cases: a null text counts as empty and has no spans; repeated rows and rows without doc_id each give a row; other
columns are ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from each later one, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LIKELY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
LONG = 64

#: The labelled table. In braces a kind and a value in which 9 stands for any digit and a for any letter.
LABELLED = (
    "Write to {email:aaaa.aa@aaaa9.example.com} or call {phone:+9 (999) 999-9999} today.",
    "mail {email:aaaaa99@aaaaa.org}, then wait",
    "aaaa aa {email:aaa_aaa@aaaa.aaa.net} aaaa",
    "Contact: <{email:aaaaaa@localhost}> for help",
    "her address is {email:aaaa@aaaa} inside",
    "{phone:+99 99 9999 9999} is the desk",
    "phone {phone:(999) 999-9999} after nine",
    "tel {phone:999-999-9999}, room 9",
    "call {phone:999.999.9999} now",
    "fax {phone:+9 999 999 9999}.",
    "aaaa {phone:+9 (999) 999-9999} aa aaa",
    "{phone:(999) 999-9999} aaaa aaa",
    "aaa {phone:999-999-9999} aa aaaa",
    "{phone:999-999-9999}, aaa",
    "aaaa aaa: {phone:999.999.9999}. Aaaa",
    "aa ({phone:999-999-9999}) aaaa",
    "aaaa {phone:+99 999 999 999}, aaa",
    "aaa {phone:+9 999 999 9999} aaaa",
    "{phone:+99 99 9999 9999}, aaa {phone:+99 99 9999 9999}",
    "aa {phone:(999) 999-9999}; aaa {phone:(999) 999-9999}.",
    "aaa ({email:a.aaaa@aaa.aa}) aaaa",
    "{email:aaaa99@aaaaaaa} aaa aa",
    "aaaa: {email:aaa@aaaaa-aaa.aaa}. Aaa",
    "aa {email:aaaa-aa@aaaaaa}, aaa {email:aaa@aaa9.aa}",
    "server {ip:99.999.99.9} went down",
    "aaaa ({ip:9.9.99.99}) aa",
    "{ip:999.99.9.99} aaa aaaa",
    "aaa {ip:99.99.99.999} {ip:9.99.999.9}",
    "aaaa aaa {ip:999.999.9.9}.",
    "from {ip:999.99.999.999}: aaaa",
    "aaa {ip:9.99.99.99}, aaaa aa",
    "ping {ip:99.9.9.999}%%% aaaa&&&",
    "card {card:9999999999999999} expires 99/99",
    "paid with {card:9999 9999 9999 9999}.",
    "aaaa {card:9999-9999-9999-9999} aaa",
    "{card:9999999999999999} {card:9999999999999999} aaaa aa",
    "aa {card:999999999999999}, aaaa",
    "{card:9999 9999 9999 9999} aaaa aa",
    "aaaa: {card:9999-9999-9999-9999}.",
    "aaa ({card:9999999999999999}) aaaa",
    "aaa {card:9999 9999 9999 9999}, aaaa 99/99",
    "{card:9999-9999-9999-9999} aaa {card:9999999999999999}",
    "aaa 9.9 aaaa 9.9.9 aa",
    "(9999) aaaa (99), aaa",
    "aaaa 99-99-9999 aaa 9999-9999",
    "aa 9 999 aaaa, 99 999 999 aa",
    "#9999 $99.99 99,999 aaaa 9st",
    "99:99:99 aaaa 9999/99/99",
    "aaa A9 aaaa9 a99a AA-99 aaa",
    "aaaa 9.99, aa 99.99%",
    "aaa 9-9 aaaa 99-999 aa",
    "aa 99999 aaaa 999999, aaa 9999999",
    "aaaa aaa aa aaaaa aaa 9999, aaaa aa",
    "Apache License, Version 9.9.",
    "Licensed under CC BY-NC 9.9.",
    "General Public License, version 9.",
    "in 9999 there were 99 of them",
    "at 99:99 on 9999-99-99 it rained",
    "token = \"9a99aa9999aa99a999aa9a9aaa99999a99aaa9a9\" aaaa",
    "password=a99aa9aa9999a99aa9 aa aaaa",
    "key AAAA9AAA99AAA9AA9AAA aaaa aa",
    "build 9.99.9 of the tool, see page 999",
    "aaaa@ aaaa @aaaa aa @ aaa",
    "price 9,999.99 or 99%",
    "aaaa%%% 999$$$ aaaa&&& 99*** aa###",
    "AAAA!! 99!! AAAA!! AA!!",
    "number 999999999 of 9999999999",
    "https://aaaa.example.com/aa/999?page=9 aaaa",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' spans, sorted."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        end = at + 1  # no later local part reaches over this sign
        if start < at and (m := _DOMAIN.match(text, end)):
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", end)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


_PLAIN = {e: ("a", "a", e, 0, False) for e in ("", ".", ",")}


def shapes(token: str) -> tuple[str, str, str, int, bool]:
    """The token's shape with digit runs counted, without counts, its last mark, its number of digits, whether it has an @."""
    if token.isalpha():
        return _PLAIN[""]
    if token[-1] in ".," and token[:-1].isalpha():
        return _PLAIN[token[-1]]
    return _shapes(token)


def _shapes(token: str) -> tuple[str, str, str, int, bool]:
    return _cached_shapes(token) if len(token) <= LONG else _shapes_of(token)


def _shapes_of(token: str) -> tuple[str, str, str, int, bool]:
    flat = re.sub(r"[^\W\d_]+", "a", token.strip("\"'<>[]{}.,;:!?%*&#$"))
    counted, flat = re.sub(r"[0-9]+", lambda m: f"{len(m[0])}d", flat), re.sub(r"[0-9]+", "9", flat)
    if len(token) > LONG:  # a long shape goes by its hash, so that no cache holds it
        counted, flat = (f"long{zlib.crc32(x.encode())}" for x in (counted, flat))
    return counted, flat, token[-1] if token[-1] in ".,:;" else "", min(sum(map(token.count, "0123456789")), 20), "@" in token


_cached_shapes = lru_cache(100_000)(_shapes_of)


@lru_cache(100_000)
def _hashed(ll: str, lc: str, l: str, own: tuple[str, str, str, int, bool], rc: str, r: str, rr: str) -> tuple[int, ...]:
    c, f, e, digits, at = own
    names = (f"c{c}", f"f{f}", f"d{digits}", f"l{l}|{f}", f"r{f}|{r}", f"lc{lc}|{c}", f"rc{c}|{rc}", f"ll{ll}|{l}|{f}", f"rr{f}|{r}|{rr}", f"e{e}{f}", "@" if at else "no@", "b")
    return tuple(zlib.crc32(n.encode()) & (Field.SIZE - 1) for n in names)


def features(tokens: list[str], first: int = 0, end: int | None = None) -> list[tuple[int, ...]]:
    """Hashed features of tokens[first:end], by the shapes of each and of two tokens on each side of it."""
    end = len(tokens) if end is None else end
    own = [("^", "^", "", 0, False)] * max(2 - first, 0) + [shapes(t) for t in tokens[max(first - 2, 0) : end + 2]] + [("$", "$", "", 0, False)] * max(end + 2 - len(tokens), 0)
    return [_hashed(a[1], b[0], b[1], c, d[0], d[1], e[1]) for a, b, c, d, e in zip(own, own[1:], own[2:], own[3:], own[4:], strict=False)]


def stretches(tokens: list[str]) -> Iterator[tuple[int, int]]:
    """First and end of each maximal run of tokens that hold a digit or an @."""
    first = None
    for i, token in enumerate(tokens):
        if _LIKELY.search(token):
            first = i if first is None else first
        elif first is not None:
            yield first, i
            first = None
    if first is not None:
        yield first, len(tokens)


class Field:
    """Weights of a linear-chain conditional random field over TAGS."""

    SIZE = 1 << 14

    def __init__(self):
        n = len(TAGS)
        self.w, self.t, self.first = np.zeros((self.SIZE, n)), np.zeros((n, n)), np.zeros(n)
        for j, tag in enumerate(TAGS):  # an inner tag only follows its own kind
            if tag[0] == "I":
                self.first[j] = -1e9
                for i, before in enumerate(TAGS):
                    if before[2:] != tag[2:] or before == "O":
                        self.t[i, j] = -1e9

    def fit(self, sequences: list[tuple[list[tuple[int, ...]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Field:
        """Adagrad on the negative log likelihood, whose gradient is expected minus seen counts."""
        rng, w2, t2 = np.random.default_rng(seed), np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        open_ = self.t > -1e8
        for _ in range(epochs):
            for at in rng.permutation(len(sequences)):
                x, y = np.array(sequences[at][0]), np.array(sequences[at][1])
                e = self.w[x].sum(1)
                n = len(y)
                alpha, beta = np.empty_like(e), np.zeros_like(e)
                alpha[0] = e[0] + self.first
                for i in range(1, n):
                    alpha[i] = _logsum(alpha[i - 1][:, None] + self.t, 0) + e[i]
                for i in range(n - 2, -1, -1):
                    beta[i] = _logsum(self.t + (e[i + 1] + beta[i + 1])[None], 1)
                z = _logsum(alpha[-1], 0)
                p = np.exp(alpha + beta - z)
                p[np.arange(n), y] -= 1
                g = np.zeros_like(self.t)
                for i in range(1, n):
                    g += np.exp(alpha[i - 1][:, None] + self.t + (e[i] + beta[i])[None] - z)
                    g[y[i - 1], y[i]] -= 1
                flat = x.ravel()
                rows = np.unique(flat)
                gw = np.zeros((len(rows), len(TAGS)))
                np.add.at(gw, np.searchsorted(rows, flat), np.repeat(p, x.shape[1], 0))
                gw += decay * self.w[rows]
                w2[rows] += gw**2
                self.w[rows] -= rate * gw / np.sqrt(w2[rows])
                t2 += g**2
                self.t[open_] -= (rate * g / np.sqrt(t2))[open_]
        self.w = self.w.astype(np.float32)
        return self

    def decode(self, sequences: list[list[tuple[int, ...]]], cells: int = 400_000) -> list[np.ndarray]:
        """The best tags of each sequence, by Viterbi over batches of sequences of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        while order:
            longest = len(sequences[order[0]])
            batch, order = order[: max(1, cells // max(1, longest))], order[max(1, cells // max(1, longest)) :]
            size = np.array([len(sequences[i]) for i in batch])
            score, back = None, np.zeros((longest, len(batch), len(TAGS)), np.int8)
            final = np.zeros((len(batch), len(TAGS)))
            for k in range(longest):
                on = int((size > k).sum())
                e = self.w[np.array([sequences[i][k] for i in batch[:on]])].sum(1)
                if score is None:
                    score = e + self.first
                else:
                    ways = score[:on, :, None] + self.t[None]
                    back[k, :on] = ways.argmax(1)
                    score = ways.max(1) + e
                done = np.flatnonzero(size[:on] == k + 1)
                final[done] = score[done]
            tag = final.argmax(1)
            for j, i in enumerate(batch):
                path, at = np.zeros(size[j], np.int64), int(tag[j])
                for k in range(size[j] - 1, -1, -1):
                    path[k] = at
                    at = int(back[k, j, at])
                out[i] = path
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def labelled(rows: tuple[str, ...] = LABELLED, copies: int = 6, seed: int = 5) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """(text, spans) by filling in each row's letters and digits, copies times."""
    rng, out = np.random.default_rng(seed), []
    letters = np.array(list("etaonrishdlu"))
    for row in rows:
        for _ in range(copies):
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{(\w+):([^}]*)\}", row):
                text += _filled(row[at : m.start()], rng, letters, "aaaa" in row or row[0] == "a")
                value = _filled(m[2], rng, letters, True)
                spans.append((len(text), m[1], len(text) + len(value)))
                text, at = text + value, m.end()
            text += _filled(row[at:], rng, letters, "aaaa" in row)
            out.append((text, spans))
    return out


def _filled(pattern: str, rng: np.random.Generator, letters: np.ndarray, words: bool) -> str:
    put = lambda c: str(rng.integers(0, 10)) if c == "9" else str(rng.choice(letters)) if c == "a" and words else str(rng.choice(letters)).upper() if c == "A" and words else c
    return "".join(put(c) for c in pattern)


def train(table: list[tuple[str, list[tuple[int, str, int]]]] | None = None) -> Field:
    """A field from labelled texts: a token that a span begins in has its B tag, later ones its I tag."""
    sequences: list[tuple[list[tuple[int, ...]], list[int]]] = []
    for text, spans in table if table is not None else labelled():
        tokens, tags = list(_TOKEN.finditer(text)), []
        for m in tokens:
            hit = next((s for s in spans if s[0] < m.end() and m.start() < s[2]), None)
            tags.append(0 if hit is None else TAGS.index(("B-" if m.start() <= hit[0] else "I-") + hit[1]))
        words = [m[0] for m in tokens]
        sequences += [(features(words, a, b), tags[a:b]) for a, b in stretches(words)]
    return Field().fit(sequences)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without marks at its ends; a + or ( may begin it and a ) end it."""
    while start < end and not (text[start].isalnum() or text[start] in "_+("):
        start += 1
    while start < end and not (text[end - 1].isalnum() or text[end - 1] in "_)"):
        end -= 1
    return start, end


def _likely_lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line that holds a digit or an @."""
    m = _LIKELY.search(text)
    while m:
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, m.start()) + 1, end
        m = _LIKELY.search(text, end)


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """For each text the field's spans that touch no base span."""
    runs, sequences = [], []
    for i, text in enumerate(texts):
        for start, end in _likely_lines(text):
            found = list(_TOKEN.finditer(text, start, end))
            words = [m[0] for m in found]
            for a, b in stretches(words):
                runs.append((i, [m.span() for m in found[a:b]]))
                sequences.append(features(words, a, b))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = [list(itertools.accumulate((e for _, _, e in b), max)) for b in base]  # the furthest end so far
    for (i, tokens), tags in zip(runs, field.decode(sequences), strict=True):
        spans = []
        for (start, end), tag in zip(tokens, tags.tolist(), strict=True):
            if TAGS[tag][0] == "B":
                spans.append([start, KINDS.index(TAGS[tag][2:]), end])
            elif TAGS[tag][0] == "I" and spans:
                spans[-1][2] = end
        for start, kind, end in spans:
            start, end = _trimmed(texts[i], start, end)
            before = bisect.bisect_left(base[i], (end,))  # base spans that start before the end
            if end > start and _LIKELY.search(texts[i], start, end) and not (before and ends[i][before - 1] > start):
                out[i].append((start, kind, end))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts are those of the base spans."""
    shared = documents.sparkSession.sparkContext.broadcast(field or train())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part["text"].to_pylist()]
                base = [base_spans(t) if _LIKELY.search(t) else [] for t in texts]
                more = added_spans(texts, base, shared.value)
                counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                sums = pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base])
                yield pa.record_batch([part["doc_id"], *counts, sums, pa.array([_listed(sorted(b + m)) for b, m in zip(base, more, strict=True)])], names)

    return documents.select("doc_id", "text").mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
