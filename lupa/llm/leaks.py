"""Benchmark decontamination with suffix arrays over the training text.

The documents of a task are taken in shards of whole texts. Each shard gets a suffix array over its
words: positions sorted by the words that follow them, by prefix doubling. Every suffix of every
benchmark item is then searched in it by bisection, word by word, which gives its longest verbatim
match and the places of all matches of a window. Words that no item holds cannot be part of a match,
so only runs of item words that are as long as the shortest window enter the array. Shards are
independent and no document leaves its task.

The items are what is searched for; they are sent to all tasks. Items of more than about ``MOST_WORDS`` words
in all are searched in parts one after the other, and what the parts find in a text is merged.

Words are runs of digits, ASCII letters in lower case and characters beyond ASCII. A window is
``window`` consecutive words of an item, or all of a shorter one. Shorter matches are not searched for. Null and
empty texts have no words, null and empty items no windows. Repeated documents, and repeated items, are rows of
their own. A very long text is a shard by itself. A text and an item that repeat the same words have very many
common windows; places and items are therefore joined by window only for the words hit and the items found, and
pairs are made for longest matches alone (``matches`` has a row for each, which is the largest part of what a
task holds). Ties cannot occur: every occurrence counts. Empty tables give empty results; columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.session import stage

WINDOW = 10
MOST_WORDS = 20_000_000

_SHARD = 4 << 20
_CHUNK = 1 << 20  # pairs made at once


class Items:
    """Benchmark items as numbers: words are numbered from 1 in the order of their hashes."""

    def __init__(self, names: list, texts: list, window: int):
        words = W.words_of(pa.array(texts, pa.string()), W.ascii_words_table())
        self.names, self.window = names, window
        self.known = np.unique(words.hash)
        self.word = np.searchsorted(self.known, words.hash) + 1
        sizes = np.diff(words.first)
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.word)) - words.first[:-1][item]
        # one entry for each suffix: its item, where it starts, how many words it has, its place in the item
        self.item, self.begin, self.left, self.place = item, np.arange(len(self.word)), sizes[item] - place, place
        self.need = np.minimum(window, sizes[item])  # words of a window of this item
        self.shortest = int(self.need.min()) if len(item) else 0
        self.runs = RunHashes(self.word)


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the non-zero entries, sorted by the ``depth`` entries from them on."""
    rank = np.append(sequence.astype(np.int64), np.zeros(1, np.int64))
    here = np.flatnonzero(sequence)
    step = 1
    order = here[np.argsort(rank[here], kind="stable")]
    while step < depth and len(here):
        top = int(rank.max()) + 1
        later = np.minimum(here + step, len(sequence))
        pair = rank[here] * top + rank[later]
        by = np.argsort(pair, kind="stable")
        order, pair = here[by], pair[by]
        fresh = np.ones(len(pair), np.int64)
        fresh[1:] = pair[1:] != pair[:-1]
        number = np.cumsum(fresh)
        rank[order] = number
        step *= 2
        if number[-1] == len(order):
            break
    return order


def search(sequence: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of the items the range in ``order`` of the places where its window occurs (empty
    if it does not)."""
    n = len(items.begin)
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.append(sequence, 0)
    active = np.flatnonzero(items.left >= items.need)
    for depth in range(int(items.need.max()) if n else 0):
        active = active[items.need[active] > depth]
        if not len(active):
            break
        wanted = items.word[items.begin[active] + depth]
        a = _bound(padded, order, depth, low[active], high[active], wanted, False)
        b = _bound(padded, order, depth, a, high[active], wanted, True)
        low[active], high[active] = a, b
        active = active[a < b]
        full = active[items.need[active] == depth + 1]
        first[full], last[full] = low[full], high[full]
    return first, last


def _bound(padded, order, depth, low, high, wanted, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        spot = order[np.minimum(middle, len(order) - 1)] + depth
        found = padded[np.minimum(spot, len(padded) - 1)]
        less = (found <= wanted if after else found < wanted) & open_
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)


@dataclass
class Shard:
    """Texts of a shard, their item words as numbers, and where the windows of the items occur in them.

    ``sequence`` holds the runs of item words, a zero after each; ``order`` is its suffix array. A window is a
    range of ``order``. Windows of one size have disjoint ranges, so the places of all windows together are
    at most as many as the words for each size; occurrences are never multiplied with items.
    """

    words: W.Words
    counts: np.ndarray
    sequence: np.ndarray
    word_at: np.ndarray  # word of each place of the sequence
    order: np.ndarray
    low: np.ndarray  # windows: range in ``order`` and number of words
    high: np.ndarray
    size: np.ndarray
    suffix: np.ndarray  # suffixes of items that begin with a window, and which window that is
    window: np.ndarray

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Window and place in the sequence of every occurrence of a window."""
        many = self.high - self.low
        window = np.repeat(np.arange(len(many)), many)
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return window, self.order[np.repeat(self.low, many) + inner]

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.first, word, "right") - 1


def shard_of(column, items: Items) -> Shard:
    words = W.words_of(column, W.ascii_words_table())
    counts = np.diff(words.first)
    none = np.zeros(0, np.int64)
    nothing = Shard(words, counts, *(none,) * 8)
    if not len(words.start) or not len(items.known):
        return nothing
    at = np.minimum(np.searchsorted(items.known, words.hash), len(items.known) - 1)
    number = np.where(items.known[at] == words.hash, at + 1, 0)
    # runs of item words inside a text that can hold a window
    border = np.ones(len(number), bool)
    border[1:] = (number[1:] > 0) != (number[:-1] > 0)
    heads = words.first[:-1]
    border[heads[heads < len(number)]] = True
    head = np.flatnonzero(border)
    size = np.diff(np.append(head, len(number)))
    keep = (number[head] > 0) & (size >= items.shortest)
    size, head = size[keep], head[keep]
    if not len(head):
        return nothing
    room = size + 1  # a zero after each run
    begin = np.cumsum(room) - room
    sequence = np.zeros(int(room.sum()), np.int64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    place, source = np.repeat(begin, size) + inner, np.repeat(head, size) + inner
    sequence[place] = number[source]
    word_at = np.zeros(len(sequence), np.int64)
    word_at[place] = source
    order = suffix_array(sequence, int(items.need.max()))
    first, last = search(sequence, order, items)
    suffix = np.flatnonzero(last > first)
    # windows of one size begin at different places of the order
    key = first[suffix] * (items.window + 1) + items.need[suffix]
    _, one, window = np.unique(key, return_index=True, return_inverse=True)
    chosen = suffix[one]
    return Shard(words, counts, sequence, word_at, order, first[chosen], last[chosen], items.need[chosen], suffix, window)


def hit_words(shard: Shard) -> np.ndarray:
    """Which words lie in an occurrence of a window."""
    n = len(shard.words.start)
    edge = np.zeros(n + 1, np.int64)
    for size in np.unique(shard.size).tolist():
        ours = shard.size == size
        covered = np.zeros(len(shard.order) + 1, np.int64)
        np.add.at(covered, shard.low[ours], 1)
        np.add.at(covered, shard.high[ours], -1)
        starts = shard.word_at[shard.order[np.cumsum(covered)[:-1] > 0]]
        edge += np.bincount(starts, minlength=n + 1) - np.bincount(starts + size, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def _chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries with at most ``most`` in all, or one entry."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, to
        at = to


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and value of all numbers of the ranges."""
    many = high - low
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def items_in_texts(shard: Shard, items: Items, most: int = _CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Text and item, once for each item with a window in a text."""
    width = np.int64(len(items.names) or 1)
    window, place = shard.places()
    pair = np.unique(shard.text_of(shard.word_at[place]) * np.int64(len(shard.size) or 1) + window)
    text, window = pair // (len(shard.size) or 1), pair % (len(shard.size) or 1)
    held = np.unique(shard.window * width + items.item[shard.suffix])
    owner, item = held // width, held % width
    low, high = np.searchsorted(owner, window), np.searchsorted(owner, window, "right")
    found = np.zeros(0, np.int64)
    for a, b in _chunks(high - low, most):
        entry, at = _expanded(low[a:b], high[a:b])
        found = np.union1d(found, text[a:b][entry] * width + item[at])
    return found // width, found % width


def longest_matches(shard: Shard, items: Items, most: int = _CHUNK) -> tuple[np.ndarray, ...]:
    """Every match of at least a window that can be extended to neither side: text, item, first word in the
    text, first word in the item, words.

    A match begins where the words before differ. Places in texts and in items are grouped by window and word
    before, and only places of different groups are paired, so that a pair is made for each match alone. Its
    length is found by bisection over hashes of runs.
    """
    window, place = shard.places()
    by = np.argsort(place, kind="stable")
    window, place = window[by], place[by]
    before = np.where(place > 0, shard.sequence[place - 1], 0)
    suffix = shard.suffix
    ahead = np.where(items.place[suffix] > 0, items.word[items.begin[suffix] - 1], -1) + 1
    base = np.int64(len(items.known) + 2)
    by = np.lexsort((suffix, ahead, shard.window))
    suffix, group = suffix[by], (shard.window * base + ahead)[by]
    low, high = np.searchsorted(group, window * base), np.searchsorted(group, (window + 1) * base)
    same = window * base + before + 1
    cut, resume = np.searchsorted(group, same), np.searchsorted(group, same, "right")
    zeros = np.flatnonzero(shard.sequence == 0)
    text_runs, item_runs = RunHashes(shard.sequence), items.runs
    out = [[np.zeros(0, np.int64)] for _ in range(5)]
    for a, b in _chunks((cut - low) + (high - resume), most):
        left, right = _expanded(low[a:b], cut[a:b]), _expanded(resume[a:b], high[a:b])
        entry = np.concatenate([left[0], right[0]]) + a
        at = suffix[np.concatenate([left[1], right[1]])]
        spot, begin = place[entry], items.begin[at]
        room = np.minimum(items.left[at], zeros[np.searchsorted(zeros, spot)] - spot)
        words = text_runs.common(spot, item_runs, begin, shard.size[window[entry]], room)
        word = shard.word_at[spot]
        text = shard.text_of(word)
        for held, found in zip(out, (text, items.item[at], word - shard.words.first[text], items.place[at], words), strict=True):
            held.append(found)
    found = [np.concatenate(x) for x in out]
    by = np.lexsort((found[3], found[2], found[1], found[0]))
    return tuple(x[by] for x in found)


class RunHashes:
    """Hashes of runs of a sequence of numbers, from running sums of weighted entries."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, sequence: np.ndarray):
        self.power = np.full(len(sequence) + 1, self._BASE, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        weighted = W.mix(sequence.astype(np.uint64) * self._BASE + np.uint64(1)) * self.power[:-1]
        self.sums = np.append(np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64))

    def common(self, here: np.ndarray, other: RunHashes, there: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most entries from ``here`` on that equal those of ``other`` from ``there`` on; at least ``low``,
        at most ``high``."""
        low, high = low.copy(), high.copy()
        mine, theirs = self.power[here], other.power[there]
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) // 2
            equal = (self.sums[here + middle] - self.sums[here]) * theirs == (other.sums[there + middle] - other.sums[there]) * mine
            low = np.where(open_ & equal, middle, low)
            high = np.where(open_ & ~equal, middle - 1, high)


def _found(items_value):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_value.value
        for whole in batches:
            for batch in W.text_batches(whole, "_text", _SHARD):
                shard = shard_of(batch.column("_text"), items)
                words, counts = shard.words, shard.counts
                hit = hit_words(shard)
                n_hit = np.bincount(words.text_of()[hit], minlength=len(counts))
                matches = longest_matches(shard, items)
                longest = np.zeros(len(counts), np.int64)
                np.maximum.at(longest, matches[0], matches[-1])
                text, item = items_in_texts(shard, items)
                bounds = np.append(0, np.cumsum(np.bincount(text, minlength=len(counts)))).astype(np.int32)
                names = pa.ListArray.from_arrays(pa.array(bounds), pa.array(items.names, pa.string()).take(pa.array(item)))
                more = [c for c in batch.schema.names if c == "_row"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), names, pa.array(longest),
                     _spans(words, hit, len(counts)), _matches(matches, items, len(counts)), *(batch.column(c) for c in more)],
                    ["_id", "n_words", "n_hit", "items", "longest", "spans", "matches", *more],
                )

    return run


def _spans(words: W.Words, hit: np.ndarray, texts: int) -> pa.Array:
    """First and last word of each run of hit words of each text."""
    owner = words.text_of()
    begins = hit.copy()
    begins[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
    ends = hit.copy()
    ends[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    base = words.first[owner[begin]]
    values = pa.StructArray.from_arrays(
        [pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["first", "last"]
    )
    bounds = np.append(0, np.cumsum(np.bincount(owner[begin], minlength=texts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _matches(matches: tuple[np.ndarray, ...], items: Items, texts: int) -> pa.Array:
    """The longest matches of each text, which come sorted by text."""
    text, item, *numbers = matches
    names = pa.array(items.names, pa.string()).take(pa.array(item))
    values = pa.StructArray.from_arrays([names, *(pa.array(x.astype(np.int32)) for x in numbers)], ["item", "first", "item_first", "words"])
    bounds = np.append(0, np.cumsum(np.bincount(text, minlength=texts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def item_parts(benchmark: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, most_words: int = MOST_WORDS) -> Iterator[Items]:
    """The items, all at once or, if they are many, in parts that fit the driver and a task one at a time."""
    rows = benchmark.select(F.col(id).cast("string").alias("name"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // (8 * most_words)))
    if parts > 1:
        rows = stage(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "items")
    for part in range(parts):
        held = (rows.where(F.col("part") == part) if parts > 1 else rows).collect()
        found = sorted(((r["name"], r["text"]) for r in held), key=lambda x: (x[0] or "", x[1] or ""))
        yield Items([x[0] for x in found], [x[1] for x in found], window)


_FOUND = (
    "n_words long, n_hit long, items array<string>, longest long, spans array<struct<first:int,last:int>>, "
    "matches array<struct<item:string,first:int,item_first:int,words:int>>"
)


def _merged(found: DataFrame) -> DataFrame:
    """One row for each ``_row`` from those of all parts of the benchmark."""
    whole = found.groupBy("_row", "_id").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.flatten(F.collect_list("matches")).alias("matches"),
    )
    spans = F.aggregate(
        "_spans", F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.get(done, F.size(done) - 1)["last"] + 1),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
                F.get(done, F.size(done) - 1)["first"].alias("first"),
                F.greatest(F.get(done, F.size(done) - 1)["last"], x["last"]).alias("last"),
            ))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return whole.withColumn("spans", spans).select("_id", "n_words", n_hit.alias("n_hit"), "items", "longest", "spans", "matches")


def find(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
         item_id: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_hit`` (words in occurrences of windows), ``items``
    (names of the items, one for each row of the benchmark that occurs), ``longest`` (words of the
    longest of its matches, 0 without), ``spans`` (first and last word of each run of hit words), ``matches``
    (every longest verbatim match of at least a window: item, first word in the text, first word in the
    item, words)."""
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = documents.schema[id].dataType.simpleString()
    found, numbered = None, None
    for items in item_parts(benchmark, item_id, item_text, window, most_words):
        if found is None:
            found = docs.mapInArrow(_found(context.broadcast(items)), f"_id {kind}, {_FOUND}")
            continue
        if numbered is None:  # several parts: rows are told apart by a number that is stored with them
            numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
            found = None
            break
    if numbered is not None:
        for items in item_parts(benchmark, item_id, item_text, window, most_words):
            part = stage(numbered.mapInArrow(_found(context.broadcast(items)), f"_id {kind}, {_FOUND}, _row long"), "part")
            found = part if found is None else found.unionByName(part)
        found = _merged(found)
    return found.withColumnRenamed("_id", id)


def _clean(items_value, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_value.value
        for whole in batches:
            for batch in W.text_batches(whole, text, _SHARD):
                shard = shard_of(batch.column(text), items)
                clean = np.ones(len(batch), bool)
                clean[shard.words.text_of()[hit_words(shard)]] = False
                yield batch.filter(pa.array(clean))

    return run


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                   item_id: str = "item_id", item_text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    left = None
    for items in item_parts(benchmark, item_id, item_text, window, most_words):
        left = documents if left is None else stage(left, "clean")
        left = left.mapInArrow(_clean(left.sparkSession.sparkContext.broadcast(items), text), documents.schema)
    return left
