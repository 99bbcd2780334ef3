"""Token ids of whole texts by the public vocabularies.

Most texts hold only ASCII and Latin letters. Those of a batch are split by the vocabulary's pattern at once: classes of
bytes give the bounds of its pieces, each piece is known by a 64-bit hash, and a table in the worker holds the ids of
pieces met before, so the library's model sees a piece only when the table lacks it. The table is direct-mapped: a new
piece takes the place of an old one of the same slot, so it stays of one size.

Any other text is cut before each single space that stands between two other characters, where neither vocabulary's
pattern can match across; each distinct part goes through the library once for as long as it stays in the worker's
cache. Parts of Latin letters and ASCII are split by the vocabulary's pattern and encoded by the library's model; all
others, and texts with runs of white space around a space, go through the library's whole encode(). Ids equal those of
encode() on the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from folium.llm.text import pieces, word_hashes

END = 1
CACHE_PARTS = 200_000
SLOT_BITS = 21  # of the table of pieces
STORE_IDS = 4 << 20  # ids that it holds before it starts anew

#: The patterns by which the two vocabularies split text.
PATTERNS = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
# Latin letters, without the one that lower case makes two of, and then ASCII marks.
_WORD = re.compile(r"([\xc0-\xd6\xd8-\xf6\xf8-įı-ɏA-Za-z]+)([!-/:-@\[-`{-~]*)").fullmatch
_PLAIN = re.compile(r"[\n\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]*").fullmatch


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """One vocabulary with two generations of cached parts: when the new one is full it becomes the old one."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary(name))
        self.lower = name.startswith("word")
        self.lead, self.shown_lead = ("", "") if self.lower else (" ", "\u0120")
        self.split = regex.compile(PATTERNS[name]).findall
        self.table = {b: c for b, c in _byte_letters().items() if chr(b) != c}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.table_ = PieceTable(self)

    def plainly(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def model(self, piece: str) -> bytes:
        """Ids of one piece of the pattern's split."""
        shown = piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.whole.model.tokenize(shown)]).tobytes()

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of a plain text."""
        if self.lower:
            raw = raw.lower() if raw.isascii() else raw.decode().lower().encode()
        return [t.id for t in self.whole.model.tokenize(raw.decode("latin-1").translate(self.table))]

    def part(self, part: str, lead: str) -> bytes:
        """Ids of a part and the space, if any, before it."""
        if not _PLAIN(part) or "<|" in part:
            return self.plainly(lead + part)
        return b"".join([self.model(p) for p in self.split(lead + (part.lower() if self.lower else part))])

    def word(self, part: str) -> bytes:
        """Ids of a part after a space: most often a word and perhaps marks, or two of these and a line break."""
        if found := _WORD(part):
            bare, marks = found.groups()
            ids = (self.new.get(bare) or self.old.get(bare)) if marks else None
            if ids is None:
                shown = bare.lower() if self.lower else bare
                if not bare.isascii():
                    shown = shown.encode().decode("latin-1").translate(self.table)
                ids = array("I", [t.id for t in self.whole.model.tokenize(self.shown_lead + shown)]).tobytes()
            if marks and "<|" not in marks:
                self.new[bare] = ids
                return ids + self.marks(marks)
            if not marks:
                return ids
        elif "\n" in part:
            first, *rest = part.split("\n")
            if all(rest) and not any(p[0].isspace() or p[-1].isspace() for p in (first, *rest)):
                return b"".join([self.word(first), *(self.after_break(p) for p in rest)])
        return self.part(part, self.lead)

    def after_break(self, part: str) -> bytes:
        """Ids of a line break and the part after it."""
        if self.lower:
            return self.word(part)
        ids = self.heads.get(part)
        if ids is None:
            ids = self.marks("\n") + self.part(part, "")
            if len(self.heads) >= CACHE_PARTS // 4:
                self.heads = {}
            self.heads[part] = ids
        return ids

    @lru_cache(10_000)  # noqa: B019  an encoder lives as long as its process
    def marks(self, marks: str) -> bytes:
        return b"".join([self.model(p) for p in self.split(marks)])

    def miss(self, part: str) -> bytes | None:
        """Ids of a part that the new generation lacks; None if the cut before or after it isn't safe."""
        ids = self.old.get(part)
        if ids is None:
            if not part or part[0].isspace() or part[-1].isspace():
                return None
            ids = self.word(part)
        if len(self.new) >= CACHE_PARTS:
            self.old, self.new = self.new, {}
        self.new[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        head, *parts = text.split(" ")
        if not head or head[-1].isspace():
            return self.plainly(text) if text else b""
        out = list(map(self.new.get, parts))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    if (ids := self.miss(parts[i])) is None:
                        return self.plainly(text)
                    out[i] = ids
        return self.part(head, "") + b"".join(out)


_MARK, _WHITE, _LETTER, _DIGIT = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[10, 32]] = _WHITE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
#: Bytes that only other texts hold: control bytes, and leads of characters beyond the Latin letters.
_OTHER = np.zeros(256, bool)
_OTHER[[*range(10), *range(11, 32), 127, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = True


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold only line breaks, printable ASCII and Latin letters, and nothing like a special token."""
    bad = _OTHER[data]
    a, b = data[:-1], data[1:]
    bad[:-1] |= (a == 60) & (b == 124)  # <|
    for lead, marks in ((0xC3, (0x97, 0xB7)), (0xC4, (0xB0,)), (0xC8, (0xBA, 0xBE))):  # two signs, and letters whose lower case is longer
        at = np.flatnonzero(a == lead)
        bad[at[np.isin(b[at], marks)]] = True
    at = np.flatnonzero(a == 0xC9)
    bad[at[b[at] > 0x8F]] = True
    before = np.concatenate([[0], np.cumsum(bad)])
    return before[offsets[1:]] == before[offsets[:-1]]


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece of plain texts by their vocabulary's pattern; `lower` is that of lower-case words.

    A piece is a run of one kind, with the space before it unless lower; of a run of white space the last character is a
    piece of its own or, a space, part of the next. With lower, digits are pieces and white space is none.
    """
    n, kind = len(data), _KIND[data]
    new = np.empty(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new[offsets] = True
    if lower:
        new[:n] |= kind == _DIGIT
    at = np.flatnonzero((data == 39) & new[:n])  # shortened words after a lone mark
    if not lower:
        at = at[(at == 0) | (data[at - 1] != 32) | np.isin(at, offsets)]
    end = offsets[np.searchsorted(offsets, at, "right")]
    fold = np.uint8(32 if lower else 0)
    one, two = (np.where(at + k < end, data[np.minimum(at + k, n - 1)] | fold, 0) for k in (1, 2))
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    short = np.isin(one, (115, 116, 109, 100))
    new[at[long | short] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    starts = np.flatnonzero(new[:n])
    ends = np.append(starts[1:], n)
    white = kind[starts] == _WHITE
    if lower:
        return starts[~white], ends[~white]
    inner = white & ~np.isin(ends, offsets)
    last = ends[inner] - 1
    new[last] = True
    spaces = last[data[last] == 32] + 1
    new[spaces] = False
    starts = np.flatnonzero(new[:n])
    return starts, np.append(starts[1:], n)


class PieceTable:
    """Ids of the pieces met last, by hash."""

    def __init__(self, encoder: Encoder, bits: int = SLOT_BITS, store: int = STORE_IDS):
        self.encoder, self.shift, self.limit = encoder, np.uint64(64 - bits), store
        self.keys, self.first, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, found: array) -> None:
        if self.used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(found)), np.uint32)])
        self.ids[self.used : self.used + len(found)] = np.frombuffer(found, np.uint32)
        self.used += len(found)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        if self.used > self.limit:
            self.keys[:], self.used = 0, 0
        hashes = word_hashes(data, starts, ends) ^ (ends - starts).astype(np.uint64)
        hashes |= np.uint64(1)  # 0 is an empty slot
        slot = (hashes >> self.shift).astype(np.int64)
        first, size = self.first[slot], self.size[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            _, one, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            one = missed[one]
            raw, found, counts, piece = data.tobytes(), array("I"), [], self.encoder.piece
            for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True):
                before = len(found)
                found.extend(piece(raw[a:b]))
                counts.append(len(found) - before)
            n = np.array(counts, np.int32)
            at = (np.cumsum(n) - n + self.used).astype(np.int32)
            self._add(found)
            first[missed], size[missed] = at[which], n[which]
            self.keys[slot[one]], self.first[slot[one]], self.size[slot[one]] = hashes[one], at, n
        before = np.cumsum(size) - size
        return self.ids[np.repeat(first - before, size) + np.arange(int(size.sum()))], size


@lru_cache(4)
def encoder(name: str) -> Encoder:
    """The vocabulary's encoder of this process."""
    return Encoder(name)


def encoded(texts: pa.Array, name: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): ids of all texts (null: empty), each with the end id; text i has ids[bounds[i]:bounds[i + 1]]."""
    own, all_, sizes = encoder(name), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for row, data, offsets in pieces(texts, most=1 << 19):
        plain = _plain(data, offsets) if len(data) else np.ones(len(offsets) - 1, bool)
        starts, ends = split(data, offsets, own.lower) if len(data) else (offsets[:0], offsets[:0])
        if not plain.all():
            kept = plain[np.searchsorted(offsets, starts, "right") - 1]
            starts, ends = starts[kept], ends[kept]
        ids, count = own.table_.lookup(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(count)])
        n = np.diff(before[np.searchsorted(starts, offsets)]) + 1
        other = {int(i): own.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(~plain)}
        for i, found in other.items():
            n[i] += len(found) // 4
        bound = np.concatenate([[0], np.cumsum(n)])
        out, free = np.empty(bound[-1], np.uint32), np.ones(bound[-1], bool)
        free[bound[1:] - 1] = False
        for i, found in other.items():
            out[bound[i] : bound[i + 1] - 1] = np.frombuffer(found, "<u4")
            free[bound[i] : bound[i + 1]] = False
        out[bound[1:] - 1] = end
        out[free] = ids
        all_.append(out)
        sizes.append(n)
    return np.concatenate(all_), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
