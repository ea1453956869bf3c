"""Removal of repeated word windows by compaction of a De Bruijn graph.

Edges of the graph are the windows of ``k`` consecutive words; two edges are neighbours when one word
separates their starts. Every window owns an anchor, the lowest hashed run of ``m`` words in it.
Consecutive windows of a text with one anchor are a path, and equal windows lie on paths with equal
anchors wherever they occur. So

1. each text is cut into its paths, (anchor, hash of the whole path), and these are shuffled once, by
   anchor. An anchor with one path does not branch: the whole path is one compacted edge, and its
   windows share their occurrences;
2. all documents with a path but that of the lowest id lose its windows;
3. only where paths branch are single windows compared, and only those of the first document of each
   path, as the others fell in step 2;
4. per document, the paths and windows that fell are looked up at their coordinates in the source
   text, together with windows that repeat inside it.

The most frequent anchors of a sample of the documents take another way to the same result, with
aggregates that combine in the map tasks and joins that can be split, so no anchor fills one task. The
sample decides the way only.

A path is compared by 128 bits (anchor and content), a window at a branch likewise. Documents with
equal ids do not remove each other's words. Null ids are one id below all others. Null and empty
texts and texts shorter than a window lose nothing. Nothing depends on partitioning or on the order
of rows. Very long texts are cut to paths whole: 32 MB in one row take some 400 MB of a worker. An empty table gives
an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.session import stage

WINDOW = 20
ANCHOR = 6
FREQUENT = 512
SAMPLE = 64  # one of so many documents

_LOWEST = -(2**63)
_PATHS = "_anchor long, _content long, _key long"


class Paths:
    """The paths of a batch of texts: for each, its anchor, content, first and last window, text."""

    def __init__(self, column, k: int, m: int):
        self.words = W.words_of(column, W.split_table())
        self.window = W.windows(self.words.hash, k)
        starts = W.whole_windows(self.words, k)
        run, spot = W.windows(self.words.hash, m), None
        if len(starts):
            spot = _lowest(run, k - m + 1)[starts]
        else:
            spot = starts
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (spot[1:] != spot[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(starts))[: len(head)] - 1
        self.begin, self.last = starts[head], starts[tail] if len(head) else starts
        self.anchor = run[spot[head]]
        size = (self.last - self.begin).astype(np.uint64)
        self.content = W.mix(self.window[self.begin] * W._BASE + self.window[self.last] + size)
        self.text = np.searchsorted(self.words.first, self.begin, "right") - 1

    def each_window(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path and start of every window of the chosen paths."""
        sizes = (self.last - self.begin + 1)[chosen]
        path = np.repeat(chosen, sizes)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return path, self.begin[path] + inner


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost lowest value in each run of ``width`` values."""
    low, at, size = values, np.arange(len(values)), 1

    def joined(step):
        later = low[step:] < low[:-step]
        return np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])

    while size * 2 <= width:
        low, at = joined(size)
        size *= 2
    if width > size:
        low, at = joined(width - size)
    return at


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _distinct(*parts: np.ndarray) -> np.ndarray:
    """Indices of the first of each group of equal rows."""
    mixed = parts[0]
    for part in parts[1:]:
        mixed = W.mix(mixed * W._BASE + part)
    return np.unique(mixed, return_index=True)[1]


def _paths_of(k: int, m: int, frequent=None, wanted: bool = False):
    """Distinct paths of each document; of ``frequent`` anchors if they are wanted, else of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                paths = Paths(batch.column("_text"), k, m)
                key = batch.column("_key").to_numpy()[paths.text]
                head = _distinct(paths.anchor, paths.content, key.view(np.uint64))
                if frequent is not None:
                    head = head[np.isin(paths.anchor[head], frequent.value) == wanted]
                yield pa.RecordBatch.from_arrays(
                    [_signed(paths.anchor[head]), _signed(paths.content[head]), pa.array(key[head])], ["_anchor", "_content", "_key"]
                )

    return run


def _windows_of(k: int, m: int):
    """Windows of the paths through the listed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                paths = Paths(batch.column("_text"), k, m)
                listed = _listed(batch.column("_anchors"))
                chosen = np.flatnonzero(np.isin(_within(paths.anchor, paths.text), listed))
                path, start = paths.each_window(chosen)
                key = batch.column("_key").to_numpy()[paths.text[path]]
                anchor, window = paths.anchor[path], paths.window[start]
                head = _distinct(anchor, window, key.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor[head]), _signed(window[head]), pa.array(key[head])], ["_anchor", "_window", "_key"]
                )

    return run


def _within(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    return W.mix(values ^ W.mix(text.astype(np.uint64) + np.uint64(1)))


def _listed(column) -> np.ndarray:
    """The numbers of a list column, each marked with its row."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return _within(values, np.repeat(np.arange(len(sizes)), sizes))


def _kept(k: int, m: int):
    """What is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                paths = Paths(batch.column("_text"), k, m)
                words, size = paths.words, len(paths.begin)
                fallen = np.isin(_within(paths.anchor ^ paths.content, paths.text), _listed(batch.column("_paths")))
                path, start = paths.each_window(np.arange(size))
                gone = fallen[path]
                text, window = paths.text[path], paths.window[start]
                single = _listed(batch.column("_windows"))
                if len(single):
                    gone |= np.isin(_within(paths.anchor[path] ^ window, text), single)
                order = np.argsort(_within(window, text), kind="stable")
                same = _within(window, text)[order]
                again = np.zeros(len(order), bool)
                again[1:] = same[1:] == same[:-1]
                gone[order] |= again
                begins = np.bincount(start[gone], minlength=len(words.start) + 1)
                ends = np.bincount(start[gone] + k, minlength=len(words.start) + 1)
                covered = np.cumsum(begins - ends)[: len(words.start)] > 0
                yield _left(batch, words, covered)

    return run


def _left(batch: pa.RecordBatch, words: W.Words, covered: np.ndarray) -> pa.RecordBatch:
    texts = len(words.first) - 1
    owner = words.text_of()
    total = np.diff(words.first)
    removed = np.bincount(owner[covered], minlength=texts)
    kept = np.flatnonzero(~covered)
    owner = owner[kept]
    follows = np.zeros(len(kept), np.int64)  # a space after each word but the last of its text
    follows[:-1] = owner[1:] == owner[:-1]
    length = words.end[kept] - words.start[kept]
    size = length + follows
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spot = np.repeat(words.start[kept], size) + inner
    joined = words.data[np.minimum(spot, max(0, len(words.data) - 1))] if len(words.data) else words.data
    joined = np.where(inner == np.repeat(length, size), np.uint8(0x20), joined)
    joined[joined == 0xFF] = 0
    bounds = np.zeros(texts + 1, np.int32)
    bounds[1:] = np.cumsum(np.bincount(owner, weights=size, minlength=texts))
    text = pa.Array.from_buffers(pa.string(), texts, [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
    return pa.RecordBatch.from_arrays(
        [batch.column("_key"), pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64)), text],
        ["_key", "n_words", "n_removed", "kept_text"],
    )


def _identity(anchor: str, other: str):
    """One number for an anchor and a content, unique among those of one document."""
    return F.col(anchor).bitwiseXOR(F.col(other))


def _frequent(source: DataFrame, k: int, m: int):
    """Anchors that are frequent in a sample of the documents, at most ``FREQUENT``."""
    sample = source.filter(F.pmod(F.xxhash64("_key"), F.lit(SAMPLE)) == 0).mapInArrow(_paths_of(k, m), _PATHS)
    counts = sample.groupBy("_anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= 32)
    found = counts.orderBy(F.desc("n"), "_anchor").limit(FREQUENT).collect()
    return source.sparkSession.sparkContext.broadcast(np.array([r["_anchor"] for r in found], np.int64).view(np.uint64))


def _compacted(source: DataFrame, k: int, m: int) -> DataFrame:
    """For each document, the paths that fell and the anchors where it holds the first of several paths."""
    frequent = _frequent(source, k, m)
    one_anchor, one_path = Window.partitionBy("_anchor"), Window.partitionBy("_anchor", "_content")
    few = (
        source.mapInArrow(_paths_of(k, m, frequent), _PATHS).repartition("_anchor")
        .withColumn("_low", F.min("_key").over(one_path))
        .withColumn("_branches", F.min("_content").over(one_anchor) != F.max("_content").over(one_anchor))
    )
    many = source.mapInArrow(_paths_of(k, m, frequent, True), _PATHS)
    firsts = many.groupBy("_anchor", "_content").agg(F.min("_key").alias("_low"))
    branching = many.groupBy("_anchor").agg((F.min("_content") != F.max("_content")).alias("_branches"))
    many = many.join(firsts, ["_anchor", "_content"]).join(branching, "_anchor")
    falls, first = F.col("_key") > F.col("_low"), F.col("_branches") & (F.col("_key") == F.col("_low"))
    return (
        few.unionByName(many).filter(falls | first).groupBy("_key").agg(
            F.collect_list(F.when(falls, _identity("_anchor", "_content"))).alias("_paths"),
            F.collect_set(F.when(first, F.col("_anchor"))).alias("_anchors"),
        )
    )


def remove_repeats(documents: DataFrame, id: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = ANCHOR) -> DataFrame:
    """Each document without the words of windows that start earlier in the corpus.

    Returns ``id``, ``n_words``, ``n_removed`` and ``kept_text`` (the words left, one space between),
    one row per input row.
    """
    kind = documents.schema[id].dataType
    docs = documents.select(F.coalesce(F.col(id).cast("long"), F.lit(_LOWEST)).alias("_key"), F.col(text).alias("_text"))
    marks = stage(_compacted(docs, k, m), "paths")
    heads = marks.filter(F.size("_anchors") > 0).select("_key", "_anchors")
    single = docs.join(heads, "_key").select("_key", "_text", "_anchors").mapInArrow(
        _windows_of(k, m), "_anchor long, _window long, _key long"
    )
    earliest = (
        single.groupBy("_anchor", "_window").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
        .filter("_low < _high").select("_anchor", "_window", "_low")
    )
    lost = (
        single.join(earliest, ["_anchor", "_window"]).filter("_key > _low")
        .groupBy("_key").agg(F.collect_list(_identity("_anchor", "_window")).alias("_windows"))
    )
    fallen = marks.filter(F.size("_paths") > 0).select("_key", "_paths")
    left = docs.join(fallen, "_key", "left").join(lost, "_key", "left").select("_key", "_text", "_paths", "_windows").mapInArrow(
        _kept(k, m), "_key long, n_words long, n_removed long, kept_text string"
    )
    named = F.when(F.col("_key") != _LOWEST, F.col("_key")).cast(kind)
    return left.select(named.alias(id), "n_words", "n_removed", "kept_text")
