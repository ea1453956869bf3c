"""Token counts that follow edits without encoding whole texts again.

For each document a tree is kept: its leaves are runs of ``LEAF`` pre-tokens with their bytes, and each
node holds the sum of the ids below it, the root the count of the document. An edit touches some
leaves. From the last leaf that starts ``MARGIN`` bytes before it, the edited text is split again until
a pre-token ends where an untouched leaf starts; from there on all is as before, since the splitting
rule never looks back. Only that region is encoded. Its count goes to its first leaf, the others of the
region become empty, and the sums above them are updated. So the shape of a tree never changes.

Null and empty texts have one empty leaf. Edits are (start, end, text) in characters, in any order;
an edit that overlaps an earlier one is an error. Edits with a null start or end are left out, a null
text deletes. Edits of unknown documents change nothing. Very long texts are trees of more leaves. An empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.llm.bpe import Vocabulary, vocabulary

LEAF = 32
MARGIN = 32

EDITS = "array<struct<start:int,end:int,text:string>>"

_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ADDRESS = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")


def grow(counts: np.ndarray) -> np.ndarray:
    """Sums of a binary tree: root first, the leaves last, padded to a power of two."""
    width = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * width - 1, np.int64)
    tree[width - 1 : width - 1 + len(counts)] = counts
    for node in range(width - 2, -1, -1):
        tree[node] = tree[2 * node + 1] + tree[2 * node + 2]
    return tree


def _add(tree: np.ndarray, leaf: int, change: int) -> None:
    node = (len(tree) + 1) // 2 - 1 + leaf
    while True:
        tree[node] += change
        if not node:
            return
        node = (node - 1) // 2


def leaves(vocab: Vocabulary, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and ids of the leaves of a column, and the number of leaves of each text."""
    pieces = vocab.pieces(column)
    _, count = vocab.encode(pieces)
    per_text = np.diff(pieces.first)
    many = -(-per_text // LEAF)
    if not len(count):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), many
    inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    head = np.repeat(pieces.first[:-1], many) + inner * LEAF
    return np.add.reduceat(pieces.end - pieces.start, head), np.add.reduceat(count, head), many


def apply(vocab: Vocabulary, data: bytes, sizes: np.ndarray, tree: np.ndarray, edits: list[tuple[int, int, bytes]]):
    """Edited bytes, sizes, tree and the number of bytes that were encoded again; edits are in bytes."""
    sizes, tree = sizes.copy(), tree.copy()
    width = (len(tree) + 1) // 2
    begins = np.cumsum(sizes) - sizes
    new, moves, at, shift = [], [], 0, 0
    for a, b, text in edits:
        if a < at or b < a or b > len(data):
            raise ValueError("edits overlap or leave the text")
        new += [data[at:a], text]
        at = b
        shift += len(text) - (b - a)
        moves.append(shift)
    new.append(data[at:])
    edited, encoded, i = b"".join(new), 0, 0
    while i < len(edits):
        first = max(0, int(np.searchsorted(begins, edits[i][0] - MARGIN, "right")) - 1)
        while first and not sizes[first]:
            first -= 1
        start = int(begins[first]) + (moves[i - 1] if i else 0)
        last, reach = i, 1
        while True:
            behind = int(np.searchsorted(begins, edits[last][1], "left"))
            after = min(max(behind, first + 1) + reach - 1, len(sizes))
            end = int(begins[after]) if after < len(sizes) else len(data)
            if last + 1 < len(edits) and edits[last + 1][0] - MARGIN < end + MARGIN:
                last, reach = last + 1, 1
                continue
            if after >= len(sizes):
                stop = look = len(edited)
            else:
                stop = end + moves[last]
                further = min(len(sizes), after + 2)
                look = (int(begins[further]) if further < len(sizes) else len(data)) + moves[last]
                if last + 1 < len(edits):
                    look = min(look, edits[last + 1][0] + moves[last])
                while look < len(edited) and edited[look] & 0xC0 == 0x80:
                    look -= 1
            pieces = vocab.pieces(pa.array([edited[start:look].decode()], pa.string()))
            if after >= len(sizes) or (stop - start in pieces.end and (look - stop >= MARGIN or look == len(edited))):
                break
            reach *= 2
        chosen = pieces.end <= stop - start
        pieces.start, pieces.end = pieces.start[chosen], pieces.end[chosen]
        _, count = vocab.encode(pieces)
        encoded += stop - start
        for leaf in range(first, min(after, len(sizes))):
            size, ids = (stop - start, int(count.sum())) if leaf == first else (0, 0)
            change = ids - int(tree[width - 1 + leaf])
            sizes[leaf] = size
            if change:
                _add(tree, leaf, change)
        i = last + 1
    return edited, sizes, tree, encoded


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in W.text_batches(whole, "_text", 2 << 20):
                sizes, counts, many = leaves(vocab, batch.column("_text"))
                bounds = np.append(0, np.cumsum(many))
                trees = [grow(counts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = [sizes[a:b] if b > a else np.zeros(1, np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.int32())), pa.array(trees, pa.list_(pa.int32()))],
                    [*batch.schema.names, "sizes", "tree"],
                )

    return run


def build(documents: DataFrame, vocabulary_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``text``, ``sizes`` (bytes of each leaf) and ``tree`` (sums of ids, the first is the count)."""
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    kind = documents.schema[id].dataType.simpleString()
    built = docs.mapInArrow(_build(vocabulary_path), f"_id {kind}, _text string, sizes array<int>, tree array<int>")
    return built.withColumnsRenamed({"_id": id, "_text": text})


def _recount(path: str, edits_of):
    """Applies the edits of the column ``edits``, or those that ``edits_of`` finds in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                yield recounted(vocab, batch)

    def recounted(vocab, batch):
        texts, n = batch.column("_text").to_pylist(), len(batch)
        given = [edits_of(t) if t else [] for t in texts] if edits_of else [
            sorted((x["start"], x["end"], x["text"] or "") for x in row or [] if x["start"] is not None and x["end"] is not None)
            for row in batch.column("edits").to_pylist()
        ]
        sizes, trees = batch.column("sizes"), batch.column("tree")
        firsts = pa.compute.list_element(trees, 0).to_numpy()
        before, after, again = firsts.astype(np.int64), firsts.astype(np.int64).copy(), np.zeros(n, np.int64)
        changed_sizes, changed_trees, changed = {}, {}, {}
        for i in [i for i in range(n) if given[i]]:
            text = texts[i] or ""
            data, edits = text.encode(), _in_bytes(text, given[i])
            edited, size, tree, again[i] = apply(
                vocab, data, np.array(sizes[i].as_py(), np.int64), np.array(trees[i].as_py(), np.int64), edits
            )
            changed[i], changed_sizes[i], changed_trees[i], after[i] = edited.decode(), size, tree, tree[0]
        if changed:
            texts = [changed.get(i, t) for i, t in enumerate(texts)]
            sizes = pa.array([changed_sizes[i].tolist() if i in changed else x for i, x in enumerate(sizes.to_pylist())], sizes.type)
            trees = pa.array([changed_trees[i].tolist() if i in changed else x for i, x in enumerate(trees.to_pylist())], trees.type)
        return pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(texts, pa.string()), sizes, trees, pa.array(before), pa.array([len(x) for x in given], pa.int64()),
             pa.array(after), pa.array(again)],
            ["_id", "_text", "sizes", "tree", "n_tokens_before", "n_edits", "n_tokens", "n_bytes_encoded"],
        )

    return run


def _in_bytes(text: str, edits) -> list[tuple[int, int, bytes]]:
    if text.isascii():
        return [(a, b, t.encode()) for a, b, t in edits]
    out, at, place = [], 0, 0
    for a, b, t in edits:
        if a < at:
            raise ValueError("edits overlap")
        start = place + len(text[at:a].encode())
        place, at = start + len(text[a:b].encode()), b
        out.append((start, place, t.encode()))
    return out


def recount(trees: DataFrame, edits: DataFrame | None, vocabulary_path: str, id: str = "doc_id", text: str = "text",
            edits_of=None) -> DataFrame:
    """The trees after edits, with ``n_tokens_before``, ``n_edits``, ``n_tokens`` and ``n_bytes_encoded``.

    ``edits`` has ``id`` and ``edits`` (type ``EDITS``), one row per document; or ``edits_of`` is a
    function from a text to its edits, which needs no join.
    """
    kind = trees.schema[id].dataType.simpleString()
    rows = trees.select(F.col(id).alias("_id"), F.col(text).alias("_text"), "sizes", "tree")
    if edits_of is None:
        given = edits.select(F.col(id).alias("_edited"), F.col("edits").cast(EDITS).alias("edits"))
        rows = rows.join(given, F.col("_id") == F.col("_edited"), "left").drop("_edited")
    out = rows.mapInArrow(
        _recount(vocabulary_path, edits_of),
        f"_id {kind}, _text string, sizes array<int>, tree array<int>, n_tokens_before long, n_edits long, n_tokens long, n_bytes_encoded long",
    )
    return out.withColumnsRenamed({"_id": id, "_text": text})


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace e-mail and network addresses by a mark."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "<email>") for m in _MAIL.finditer(text)]
    if text.count(".") > 2:
        found += [(m.start(), m.end(), "<ip>") for m in _ADDRESS.finditer(text)]
    found.sort()
    return [x for i, x in enumerate(found) if not i or x[0] >= found[i - 1][1]]
