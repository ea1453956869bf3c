"""Byte-pair encoding of many texts with a vocabulary file of the ``tokenizers`` library.

A vocabulary cuts a text into pre-tokens and encodes each on its own, so equal pre-tokens have equal
ids. Here a whole column is cut at once over its bytes, equal pre-tokens are found by sorting their
64-bit hashes, and the library encodes each different one once per worker, which remembers it. That
cutting covers texts of ASCII and Latin letters; all others are cut by the library. The memory of a
worker is bounded by ``REMEMBERED`` pre-tokens, after which it starts anew.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lupa.llm import words as W

REMEMBERED = 600_000

_POOL = 16 * REMEMBERED
_BLANK, _LETTER, _DIGIT, _OTHER = 1, 2, 3, 4
_APOSTROPHE = 0x27
# What follows an apostrophe in a contraction.
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_LETTERS = {b: c for c, b in byte_letters().items()}


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_LETTERS)


def _classes() -> np.ndarray:
    """Class of each byte of a plain text; 0 marks bytes that plain texts don't have.

    Plain are ASCII without the controls that engines disagree on, and letters from U+00C0 to U+017F,
    whose first byte is C3, C4 or C5.
    """
    out = np.zeros(256, np.uint8)
    out[:0x80] = _OTHER
    out[0x1C:0x20] = 0
    out[[0x20, *range(0x09, 0x0E)]] = _BLANK
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[0x80:0xC0] = _LETTER
    out[[0xC3, 0xC4, 0xC5]] = _LETTER
    return out


_CLASS = _classes()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


class Pieces:
    """Pre-tokens of a column as ordered byte ranges, and for each text its first pre-token."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.offsets, self.start, self.end = data, offsets, start, end
        self.first = np.searchsorted(start, offsets)

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


class Vocabulary:
    """A vocabulary file; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_str(json.dumps(rules | {"truncation": None, "padding": None}))
        self.specials = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        before = rules["pre_tokenizer"] or {}
        self.covers = rules["normalizer"] is None and before.get("type") == "ByteLevel" and not before["add_prefix_space"]
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        self.folds = steps == ["NFC", "Replace", "Lowercase"] and rules["model"].get("end_of_word_suffix") == "</w>"
        self.size = max(self.tokenizer.get_vocab(True).values()) + 1
        self._forget()

    # -- cutting --------------------------------------------------------------

    def pieces(self, column) -> Pieces:
        """For vocabularies of bytes, ranges that cover the texts; otherwise what is left of them."""
        data, offsets = W.column_bytes(column)
        kind = _CLASS[data]
        plain = self._plain(data, offsets, kind)
        if not plain.all():
            kind = kind * np.repeat(plain, np.diff(offsets)).astype(np.uint8)
        if self.covers:
            start, end = _cut_covering(data, offsets, kind)
        elif self.folds:
            start, end = _cut_words(data, offsets, kind)
        else:
            start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
        odd = np.flatnonzero(~plain & (np.diff(offsets) > 0))
        if len(odd):
            more = [self._cut_odd(data, offsets[i], offsets[i + 1]) for i in odd]
            start = np.concatenate([start, *(x[0] for x in more)])
            end = np.concatenate([end, *(x[1] for x in more)])
            order = np.argsort(start, kind="stable")
            start, end = start[order], end[order]
        return Pieces(data, offsets, start, end)

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        bad = kind == 0
        if self.folds:
            bad |= (data == 0xB0) & (np.append(np.uint8(0), data[:-1]) == 0xC4)[: len(data)]  # dotted capital I
        lead = data == 0xC3
        if lead.any():
            at = np.flatnonzero(lead[:-1])
            bad[at[np.isin(data[at + 1], (0x97, 0xB7))]] = True  # times and division
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, np.int64)
        whole = data.tobytes() if len(marks) else b""
        for mark in marks.tolist():
            if any(whole.startswith(x.encode(), mark) for x in self.specials):
                bad[mark] = True
        total = np.append(0, np.cumsum(bad))
        return (total[offsets[1:]] - total[offsets[:-1]] == 0) & (self.covers or self.folds)

    def _cut_odd(self, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """By the library: pre-tokens where they cover the text, otherwise the text as a whole."""
        if not self.covers:
            return np.array([a]), np.array([b])
        sizes = []
        for part in self._parts(data[a:b].tobytes().decode()):
            if part in self.specials:
                sizes.append(len(part.encode()))
            elif part:
                sizes += [len(shown) for shown, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        end = a + np.cumsum(np.array(sizes, np.int64))
        return end - np.array(sizes, np.int64), end

    def has_special_text(self, text: str) -> bool:
        return any(x in text for x in self.specials)

    def _parts(self, text: str) -> list[str]:
        return self.special.split(text) if self.special else [text]

    # -- encoding -------------------------------------------------------------

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.spot = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, "<u4")
        self.used = 0

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column and the number of each text, as the library's ``encode_batch(texts,
        add_special_tokens=False)``; null is an empty text."""
        pieces = self.pieces(column)
        ids, counts = self.encode(pieces)
        total = np.append(0, np.cumsum(counts))
        return ids, np.diff(total[pieces.first])

    def encode(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each piece."""
        if not len(pieces.start):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        spot, count = self._find(pieces)
        total = np.cumsum(count)
        at = np.repeat(spot - (total - count), count) + np.arange(int(total[-1]))
        return self.pool[at], count

    def _find(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > REMEMBERED or self.used > _POOL:
            self._forget()
        data = _FOLD[pieces.data] if self.folds else pieces.data
        hashed = W.hashes(data, pieces.start, pieces.end, seed=7)
        order = np.argsort(hashed)
        ordered = hashed[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        key = ordered[fresh]
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        new = np.flatnonzero(~known)
        if len(new):
            spot, count = self._learn(pieces, order[np.flatnonzero(fresh)[new]])
            self.keys = np.insert(self.keys, at[new], key[new])
            self.spot = np.insert(self.spot, at[new], spot)
            self.count = np.insert(self.count, at[new], count)
            at = np.searchsorted(self.keys, key)
        which = np.empty(len(order), np.int64)
        which[order] = at[np.cumsum(fresh) - 1]
        return self.spot[which], self.count[which].astype(np.int64)

    def _learn(self, pieces: Pieces, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = pieces.data.tobytes()
        found = [
            self._ids(whole[a:b])
            for a, b in zip(pieces.start[chosen].tolist(), pieces.end[chosen].tolist(), strict=True)
        ]
        count = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for one in found for x in one), np.uint32, int(count.sum()))
        if self.used + len(flat) > len(self.pool):
            larger = np.zeros(2 * (self.used + len(flat)), "<u4")
            larger[: self.used] = self.pool[: self.used]
            self.pool = larger
        self.pool[self.used : self.used + len(flat)] = flat
        spot = self.used + np.cumsum(count) - count
        self.used += len(flat)
        return spot, count

    def _ids(self, data: bytes) -> list[int]:
        """Ids of one piece: by the library's model if it is a pre-token, else by all of the library."""
        if self.covers:
            known = self.specials.get(data.decode("utf-8", "replace")) if data.startswith(b"<|") else None
            return [known] if known is not None else [t.id for t in self.tokenizer.model.tokenize(as_letters(data))]
        text = data.decode()
        if self.folds and _ALONE.fullmatch(text):
            return [t.id for t in self.tokenizer.model.tokenize(as_letters(text.lower().encode()))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def one_piece(self, data: bytes) -> np.ndarray:
        """Ids of bytes that are taken as a single pre-token, whatever they hold."""
        return np.array([t.id for t in self.tokenizer.model.tokenize(as_letters(data))], "<u4")

    # -- decoding -------------------------------------------------------------

    @property
    def token_bytes(self) -> list[bytes]:
        if not hasattr(self, "_token_bytes"):
            letters = byte_letters()
            known = self.tokenizer.get_vocab(True)
            table = [b""] * (max(known.values()) + 1)
            for token, number in known.items():
                shown = all(c in letters for c in token)
                table[number] = bytes(letters[c] for c in token) if shown else token.encode()
            self._token_bytes = table
        return self._token_bytes

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``, for vocabularies of bytes."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _runs(offsets: np.ndarray, kind: np.ndarray, single: int = 0) -> np.ndarray:
    """Starts of the runs of one class; each byte of the class ``single`` is a run."""
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    if single:
        fresh |= kind == single
    fresh[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return np.flatnonzero(fresh)


def _cut_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, single digits, runs of others; what holds an apostrophe stays in one piece."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kind.copy()
    marks = np.flatnonzero((data == _APOSTROPHE) & (kind > 0))
    if len(marks):
        chunk = _runs(offsets, (kind > _BLANK).astype(np.uint8))
        held = np.unique(np.searchsorted(chunk, marks, "right") - 1)
        bounds = np.append(chunk, len(data))
        for one in held.tolist():
            kind[bounds[one] : bounds[one + 1]] = 5
    start = _runs(offsets, kind, _DIGIT)
    end = np.append(start[1:], len(data))
    real = kind[start] > _BLANK
    return start[real], end[real]


def _cut_covering(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters, digits and others, each with one space before it if there is one; contractions;
    runs of blanks, where the last blank before something else stands alone."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = _runs(offsets, kind)
    bounds = np.append(start, len(data))
    blank = kind[start] == _BLANK
    inside = np.zeros(len(start), bool)  # followed by a run of the same text
    inside[:-1] = ~np.isin(start[1:], offsets)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[start] = True
    # the last blank of a run before something else: a space joins it, another blank is alone
    last = bounds[1:] - 1
    before = np.flatnonzero(blank & inside)
    fresh[last[before]] = True
    joined = before[data[last[before]] == 0x20]
    fresh[bounds[joined + 1]] = False
    # contractions, where the apostrophe is a run of its own without a space before it
    lone = np.flatnonzero((data[start] == _APOSTROPHE) & (bounds[1:] - start == 1) & (kind[start] == _OTHER) & inside)
    lone = lone[fresh[start[lone]]]
    lone = lone[kind[start[lone + 1]] == _LETTER]
    for one in lone.tolist():
        rest = data[start[one + 1] : min(start[one + 1] + 2, bounds[one + 2])].tobytes().decode("latin-1")
        short = next((x for x in _CONTRACTED if rest.startswith(x)), None)
        if short:
            fresh[start[one + 1]] = False
            fresh[start[one + 1] + len(short)] = True
    cut = np.flatnonzero(fresh[:-1])
    ends = np.append(cut[1:], len(data))
    real = kind[cut] > 0
    return cut[real], ends[real]


_ALONE = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+|[0-9]|[!#-&(-/:-@\\[-`{-~]+")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(path)


def id_lists(ids: np.ndarray, counts: np.ndarray, width: str = "<u4") -> pa.Array:
    """Ids as one binary value for each text."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    bounds[1:] = np.dtype(width).itemsize * np.cumsum(counts)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(ids, width))])
