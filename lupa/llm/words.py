"""Words of whole texts as numpy arrays, computed over the UTF-8 bytes of an Arrow column.

All operators that compare words share this step. A word is a maximal run of bytes that are not
separators, and it never crosses the border of a text. Bytes of one word are folded into a 64-bit
hash; equal words always have equal hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_GROUP_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_table(separators=BLANKS) -> np.ndarray:
    """Byte to byte; separators become 0."""
    table = np.arange(256, dtype=np.uint8)
    table[list(separators)] = 0
    # NUL is a character of a word like any other, but 0 marks separators
    if 0 not in separators:
        table[0] = 0xFF  # never occurs in UTF-8
    return table


def ascii_words_table() -> np.ndarray:
    """Lower-cased words of digits, letters and everything beyond ASCII."""
    table = np.zeros(256, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


@dataclass
class Words:
    """Words of a column of texts: byte ranges, hashes, and for each text its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more entry than texts
    hash: np.ndarray
    offsets: np.ndarray  # byte range of each text

    def text_of(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _weights(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE + np.uint64(seed))


def _powers(n: int, seed: int) -> np.ndarray:
    base = np.full(n, _BASE + np.uint64(2 * seed), dtype=np.uint64)
    if n:
        base[0] = 1
    return np.multiply.accumulate(base)


def words_of(column, table: np.ndarray, seed: int = 0) -> Words:
    data, offsets = column_bytes(column)
    data = table[data]
    inside = data != 0
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
    cut = offsets[1:-1]
    after[cut[(cut > 0)] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets), hashes(data, start, end, seed), offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are ordered, do not overlap and are not empty."""
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    weight = _weights(seed)
    power = _powers(int((end - start).max()), seed)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _GROUP_BYTES)))
        length = end[at:to] - start[at:to]
        begins = np.cumsum(length) - length
        inner = np.arange(int(length.sum())) - np.repeat(begins, length)
        spot = inner + np.repeat(start[at:to], length)
        out[at:to] = np.add.reduceat(weight[data[spot]] * power[inner], begins)
        at = to
    return mix(out + (end - start).astype(np.uint64))


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values; shorter by ``k - 1`` than ``values``."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, run, size = None, 0, values, 1
    rest = k
    while rest:
        if rest & 1:
            part = run[covered : covered + n]
            out = mix(part + np.uint64(k)) if out is None else mix(out * _BASE + part)
            covered += size
        rest >>= 1
        if rest:
            run = mix(run[:-size] * _BASE + run[size:] + np.uint64(size))
            size *= 2
    return out


def whole_windows(words: Words, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` words that stay inside one text."""
    n = max(0, len(words.start) - k + 1)
    if not n:
        return np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], np.diff(words.first))[:n]
    return np.flatnonzero(np.arange(n) + k <= last)


def free_name(columns: Sequence[str], name: str) -> str:
    """A column name that the columns do not have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``most_bytes`` of text, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the machine: workers live on for the tasks of later stages, and what
    their allocators keep would add up."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
