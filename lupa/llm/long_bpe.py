"""Encoding and decoding of whole texts, where long texts are encoded in parts and joined as a tree.

Texts of up to ``PART`` bytes are encoded where they are read. A longer one is halved until its parts
are that short; the parts of all documents are spread over the cluster and encoded alone. Cutting
changes the ids near the cut, so neighbours are joined pair by pair up to the whole text:

* a pre-token that starts ``MARGIN`` bytes before the cut starts there in the whole text too, since
  the splitting rule looks ahead by three characters and never back;
* from it on, a window around the cut is split again. Once it ends a pre-token where the right part
  starts one, everything behind is as it was; otherwise the window grows;
* a long pre-token across the cut, such as a text without blanks, is joined by ids: a window of ids on
  both sides is encoded again and grows until its outer ids come out unchanged. A sequence of ids is
  the encoding of its bytes if each two neighbours are the encoding of theirs, so the join is exact.

Special tokens are cut out first and never lie in a window. Null and empty texts have no ids.
Repeated rows give repeated results. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.llm.bpe import Vocabulary, id_lists, vocabulary

PART = 1 << 15
MARGIN = 32

_WINDOW = 64
_LONG = 1 << 12


@dataclass
class Encoded:
    """Bytes, sizes of their pre-tokens, ids of each pre-token and all ids."""

    data: bytes
    size: np.ndarray
    count: np.ndarray
    ids: np.ndarray

    def ids_before(self, piece: int) -> np.ndarray:
        return self.ids[: int(self.count[:piece].sum())]

    def ids_from(self, piece: int) -> np.ndarray:
        return self.ids[int(self.count[:piece].sum()) :]


def encoded(vocab: Vocabulary, data: bytes) -> Encoded:
    pieces = vocab.pieces(pa.array([data.decode()], pa.string()))
    ids, count = vocab.encode(pieces)
    return Encoded(data, pieces.end - pieces.start, count, ids)


def joined(vocab: Vocabulary, a: Encoded, b: Encoded) -> Encoded:
    """The encoding of the bytes of ``a`` and ``b`` together."""
    if not a.data or not b.data:
        return b if b.data else a
    begins = np.cumsum(a.size) - a.size
    keep = max(0, int(np.searchsorted(begins, len(a.data) - MARGIN, "right")) - 1)
    left, cut = a.data[int(begins[keep]) :], len(a.data) - int(begins[keep])
    ends = np.cumsum(b.size)
    reach = _WINDOW
    while True:
        used = min(len(ends) - 1, int(np.searchsorted(ends, reach)))
        window = left + b.data[: int(ends[used])]
        pieces = vocab.pieces(pa.array([window.decode()], pa.string()))
        whole = used == len(ends) - 1
        agreed = pieces.end[(pieces.end >= cut) & (pieces.end <= len(window) - MARGIN)] - cut
        agreed = agreed[np.isin(agreed, np.append(0, ends))]
        if len(agreed) or whole:
            stop = int(agreed[0]) if len(agreed) else int(ends[-1])
            break
        reach = 2 * int(ends[used]) + _WINDOW
    skip = int(np.searchsorted(ends, stop, "right")) if stop else 0
    chosen = pieces.end <= cut + stop
    start, end = pieces.start[chosen], pieces.end[chosen]
    ids, count = [], []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        across = s < cut < e and e - s > _LONG
        if across and cut - s == int(a.size[-1]) and e - cut == int(b.size[0]):
            found = joined_ids(vocab, a.ids_from(len(a.size) - 1), b.ids_before(1))
        elif e - s > _LONG:
            found = _alone(vocab, window[s:e])
        else:
            found = None
        ids.append(found)
    short = [i for i, x in enumerate(ids) if x is None]
    if short:
        pieces.start, pieces.end = start[short], end[short]
        flat, sizes = vocab.encode(pieces)
        bounds = np.append(0, np.cumsum(sizes))
        for n, i in enumerate(short):
            ids[i] = flat[bounds[n] : bounds[n + 1]]
    count = np.array([len(x) for x in ids], np.int64)
    return Encoded(
        a.data + b.data,
        np.concatenate([a.size[:keep], end - start, b.size[skip:]]),
        np.concatenate([a.count[:keep], count, b.count[skip:]]),
        np.concatenate([a.ids_before(keep), *ids, b.ids_from(skip)]),
    )


def _alone(vocab: Vocabulary, data: bytes) -> np.ndarray:
    special = vocab.specials.get(data.decode("utf-8", "replace"))
    return vocab.one_piece(data) if special is None else np.array([special], "<u4")


def joined_ids(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ids of one pre-token from those of its two parts."""
    reach = 4
    while True:
        left, right = a[-reach:], b[:reach]
        found = vocab.one_piece(vocab.decode_bytes(left) + vocab.decode_bytes(right))
        left_agrees = reach >= len(a) or found[0] == left[0]
        right_agrees = reach >= len(b) or found[-1] == right[-1]
        if left_agrees and right_agrees:
            return np.concatenate([a[: max(0, len(a) - reach)], found, b[reach:]])
        reach *= 2


def tree(vocab: Vocabulary, parts: list[Encoded]) -> Encoded:
    """Joins neighbours until one is left."""
    while len(parts) > 1:
        pairs = [joined(vocab, a, b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def halves(data: bytes, most: int) -> list[bytes]:
    """Parts of at most ``most`` bytes, or one character, cut between characters."""
    middle = len(data) // 2
    while middle and data[middle] & 0xC0 == 0x80:
        middle -= 1
    if len(data) <= most or not middle:
        return [data]
    return halves(data[:middle], most) + halves(data[middle:], most)


# -- on tables ----------------------------------------------------------------


def _decoded(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Text of each document's ids."""
    if not hasattr(vocab, "_flat_bytes"):
        table = vocab.token_bytes
        vocab._byte_count = np.array([len(x) for x in table], np.int64)
        vocab._byte_start = np.cumsum(vocab._byte_count) - vocab._byte_count
        vocab._flat_bytes = np.frombuffer(b"".join(table), np.uint8)
    size = vocab._byte_count[ids]
    total = np.append(0, np.cumsum(size))
    data = vocab._flat_bytes[np.repeat(vocab._byte_start[ids] - total[:-1], size) + np.arange(int(total[-1]))]
    bounds = total[np.append(0, np.cumsum(counts))].astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
    return text


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in W.text_batches(whole, "_text", 2 << 20):
                ids, counts = vocab.encode_column(batch.column("_text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(counts), id_lists(ids, counts), _decoded(vocab, ids, counts)],
                    ["_id", "n_tokens", "ids", "decoded"],
                )

    return run


_PARTS = "_id {id}, _one long, _other int, _place int, _special boolean, _part binary"


def _cut(path: str, most: int, schema: pa.Schema):
    """Parts of long texts in order; special tokens are parts of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for row in batch.to_pylist():
                place = 0
                for text in vocab._parts(row["_text"]):
                    special = text in vocab.specials
                    parts = [text.encode()] if special else halves(text.encode(), most)
                    yield pa.RecordBatch.from_pylist([
                        {"_id": row["_id"], "_one": row["_one"], "_other": row["_other"], "_place": place + i, "_special": special, "_part": x}
                        for i, x in enumerate(parts)
                    ], schema)
                    place += len(parts)

    return run


def _encode_parts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column("_part").cast(pa.string())
            pieces = vocab.pieces(texts)
            ids, count = vocab.encode(pieces)
            size = pieces.end - pieces.start
            per_text = np.diff(pieces.first)
            total = np.append(0, np.cumsum(count))
            columns = [
                id_lists(size, per_text), id_lists(count, per_text), id_lists(ids, np.diff(total[pieces.first])),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_sizes", "_counts", "_ids"])

    return run


def _join(path: str, schema: pa.Schema):
    """One document from its parts; rows that repeat a document repeat its result."""

    def run(parts: pa.Table) -> pa.Table:
        vocab = vocabulary(path)
        rows = sorted(parts.to_pylist(), key=lambda r: r["_place"])
        copies = sum(r["_place"] == 0 for r in rows)
        out, run_ = [], []

        def close():
            if run_:
                out.append(tree(vocab, run_).ids)
                run_.clear()

        for row in rows[::copies]:
            one = Encoded(row["_part"], *(np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("_sizes", "_counts")), np.frombuffer(row["_ids"], "<u4"))
            if row["_special"]:
                close()
                out.append(one.ids)
            elif one.data:
                run_.append(one)
        close()
        ids = np.concatenate(out)
        counts = np.array([len(ids)])
        text = _decoded(vocab, ids, counts)[0].as_py()
        row = {"_id": rows[0]["_id"], "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes(), "decoded": text}
        return pa.Table.from_pylist([row] * copies, schema)

    return run


def encode_decode(documents: DataFrame, vocabulary_path: str, id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """``id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` text of each row."""
    kind = documents.schema[id].dataType.simpleString()
    docs = documents.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    result = f"_id {kind}, n_tokens long, ids binary, decoded string"
    long = F.octet_length("_text") > part
    short = docs.filter(~F.coalesce(long, F.lit(False))).mapInArrow(_short(vocabulary_path), result)
    named = docs.filter(long).withColumns({"_one": F.xxhash64("_text"), "_other": F.hash("_text")})
    schema = _PARTS.format(id=kind)
    arrow = pa.schema([
        ("_id", documents.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type), ("_one", pa.int64()),
        ("_other", pa.int32()), ("_place", pa.int32()), ("_special", pa.bool_()), ("_part", pa.binary()),
    ])
    done = pa.schema([arrow.field(0), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    parts = named.mapInArrow(_cut(vocabulary_path, part, arrow), schema).repartition("_id", "_one", "_place")
    ready = parts.mapInArrow(_encode_parts(vocabulary_path), f"{schema}, _sizes binary, _counts binary, _ids binary")
    whole = ready.groupBy("_id", "_one", "_other").applyInArrow(_join(vocabulary_path, done), result)
    return short.union(whole).withColumnRenamed("_id", id)
