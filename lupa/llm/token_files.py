"""Token ids in binary files, packed with a static asymmetric numeral system.

One table of frequencies, counted over all ids, serves every file. A file is a row of independent
blocks of whole documents. In a block, token ``i`` belongs to lane ``i % LANES``; the lanes are coded
side by side with 64-bit states and 32-bit words, so that one numpy step codes one token of each lane.
Every ``STRIDE`` steps the states and the place in the words are kept as a checkpoint: the parts between
checkpoints can be decoded without each other, and each part has a checksum of its ids.

File layout (little-endian)::

    magic "RANS1\\0\\0\\0" | checksum of the frequency table (u4) | blocks | footer | its size (u4) | magic

The footer lists offset, size, first document, documents and tokens of each block. The frequency
table is the Parquet dataset ``table`` beside the files, the list of files is the dataset
``manifest``. Only files in the manifest count: a task that is run again leaves an unlisted file.

A very long text is encoded whole and stays in one block. An empty table gives an empty manifest. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.llm.bpe import id_lists, vocabulary
from lupa.session import application_dir

BITS = 20
LANES = 4096
STRIDE = 256
BLOCK_TOKENS = 1 << 22
MOST_TASKS = 50_000

_MAGIC = b"RANS1\0\0\0"
_LOW = np.uint64(1 << 32)
_MANIFEST = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("shard", "first", "offset", "size", "documents", "tokens"))])
_HEAD = struct.Struct("<IIIIII")  # documents, tokens, words, checkpoints, checksum of the words, lanes


@dataclass
class Table:
    """Frequencies scaled to ``2**BITS``, their running sums, and the symbol of each slot."""

    frequency: np.ndarray
    before: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, frequency: np.ndarray) -> Table:
        frequency = frequency.astype(np.uint64)
        before = np.cumsum(frequency) - frequency
        return cls(frequency, before, np.repeat(np.arange(len(frequency), dtype=np.uint32), frequency.astype(np.int64)))

    @property
    def checksum(self) -> int:
        return zlib.crc32(self.frequency.astype("<u4").tobytes())


def scaled(counts: np.ndarray) -> np.ndarray:
    """Whole numbers with the sum ``2**BITS``, at least 1 for every id that occurs."""
    total, goal = int(counts.sum()), 1 << BITS
    if not total:
        out = np.zeros(max(1, len(counts)), np.int64)
        out[0] = goal
        return out
    if np.count_nonzero(counts) > goal:
        raise ValueError(f"more than {goal} different ids")
    share = counts / total * goal
    out = np.where(counts > 0, np.maximum(1, np.floor(share)), 0).astype(np.int64)
    over = int(out.sum()) - goal
    order = np.argsort(-out, kind="stable")
    if over < 0:
        out[order[0]] -= over
    while over > 0:
        spare = np.maximum(out[order] - 1, 0)
        take = np.minimum(spare, np.maximum(1, over * out[order] // goal))
        take = np.where(np.cumsum(take) <= over, take, np.maximum(0, over - (np.cumsum(take) - take)))
        out[order] -= take
        over -= int(take.sum())
    return out


def pack(ids: np.ndarray, table: Table, lanes: int = LANES, stride: int = STRIDE) -> bytes:
    """One block without its directory: checkpoints and words."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    frequency, before = table.frequency[ids], table.before[ids]
    words, kept = [], []
    shift, top = np.uint64(BITS), np.uint64(64 - BITS)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(len(ids), (step + 1) * lanes)
        f, x = frequency[a:b], state[: b - a]
        over = (x >> top) >= f
        words.append(x[over].astype("<u4"))
        x = np.where(over, x >> np.uint64(32), x)
        quotient = x // f
        state[: b - a] = (quotient << shift) + (x - quotient * f) + before[a:b]
        if step % stride == 0:
            kept.append(state.copy())
    words.reverse()
    kept.reverse()
    sizes = np.array([len(x) for x in words], np.int64)
    place = (np.cumsum(sizes) - sizes)[::stride].astype("<u4")
    sums = np.array([zlib.crc32(ids[a : a + lanes * stride].astype("<u4").tobytes()) for a in range(0, len(ids), lanes * stride)], "<u4")
    stream = np.concatenate(words).tobytes() if words else b""
    states = np.concatenate(kept).astype("<u8").tobytes() if kept else b""
    return place.tobytes() + sums.tobytes() + states + stream


def unpack_part(place: int, state: np.ndarray, stream: np.ndarray, count: int, table: Table) -> np.ndarray:
    """The ids from one checkpoint on."""
    lanes = len(state)
    out = np.empty(count, np.uint32)
    state, at = state.astype(np.uint64), place
    mask, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    for a in range(0, count, lanes):
        b = min(count, a + lanes)
        x = state[: b - a]
        slot = x & mask
        symbol = table.symbol[slot.astype(np.int64)]
        out[a:b] = symbol
        x = table.frequency[symbol] * (x >> shift) + slot - table.before[symbol]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[at : at + len(low)]
        at += len(low)
        state[: b - a] = x
    return out


def block(documents: pa.Array, counts: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    """A block: head, directory of documents (id, known or null, number of ids), packed ids."""
    known = np.asarray(documents.is_valid())
    names = documents.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    body = pack(ids, table)
    parts = -(-len(ids) // (LANES * STRIDE))
    fixed = parts * (8 + 8 * LANES)
    head = _HEAD.pack(len(counts), len(ids), (len(body) - fixed) // 4, parts, zlib.crc32(body), LANES)
    return head + names.tobytes() + known.astype("u1").tobytes() + counts.astype("<u4").tobytes() + body


def read_block(data: bytes, table: Table, stride: int = STRIDE):
    """Ids of documents, numbers of ids, ids. Raises ValueError if a checksum differs."""
    n, tokens, words, parts, checksum, lanes = _HEAD.unpack_from(data)
    at = _HEAD.size
    names = np.frombuffer(data, "<i8", n, at)
    known = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
    counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    if zlib.crc32(memoryview(data)[at:]) != checksum:
        raise ValueError("a block of tokens is damaged")
    place = np.frombuffer(data, "<u4", parts, at)
    sums = np.frombuffer(data, "<u4", parts, at + 4 * parts)
    states = np.frombuffer(data, "<u8", parts * lanes, at + 8 * parts).reshape(parts, lanes)
    stream = np.frombuffer(data, "<u4", words, at + parts * (8 + 8 * lanes))
    out = np.empty(tokens, np.uint32)
    for part in range(parts):
        a = part * lanes * stride
        b = min(tokens, a + lanes * stride)
        out[a:b] = unpack_part(int(place[part]), states[part], stream, b - a, table)
        if zlib.crc32(out[a:b].astype("<u4").tobytes()) != sums[part]:
            raise ValueError("decoded tokens differ from those written")
    return pa.array(names, mask=~known), counts, out


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class Blocks:
    """Collects documents to blocks of about ``BLOCK_TOKENS`` ids and writes them to one file."""

    def __init__(self, folder: str, shard: int, first: int, table: Table):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        self.name = f"tokens-{shard:06d}-{first:09d}-{uuid.uuid4().hex}.rans"
        self.table, self.listed, self.size, self.shard, self.first = table, [], len(_MAGIC) + 4, shard, first
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.file.write(_MAGIC + struct.pack("<I", table.checksum))
        self._start()

    def _start(self) -> None:
        self.documents, self.counts, self.ids, self.held = [], [], [], 0

    def add(self, documents: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        total = np.append(0, np.cumsum(counts))
        at = 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + BLOCK_TOKENS - self.held)))
            to = min(to, len(counts))
            self.documents.append(documents.slice(at, to - at))
            self.counts.append(counts[at:to])
            self.ids.append(ids[total[at] : total[to]])
            self.held += int(total[to] - total[at])
            if self.held >= BLOCK_TOKENS:
                self.write()
            at = to

    def write(self) -> None:
        if not self.documents:
            return
        counts = np.concatenate(self.counts)
        data = block(pa.concat_arrays(self.documents), counts, np.concatenate(self.ids), self.table)
        self.listed.append({
            "file": self.name, "shard": self.shard, "first": self.first, "offset": self.size, "size": len(data),
            "documents": len(counts), "tokens": int(counts.sum()),
        })
        self.first += len(counts)
        self.file.write(data)
        self.size += len(data)
        self._start()

    def close(self) -> pa.RecordBatch:
        self.write()
        footer = json.dumps(self.listed).encode()
        self.file.write(footer + struct.pack("<I", len(footer)) + _MAGIC)
        self.file.close()
        return pa.RecordBatch.from_pylist(self.listed, _MANIFEST)


def _encoder(path: str, end_id: int | None, width: str):
    """Ids of each document of a task, with its place in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        place = 0
        for whole in batches:
            for batch in W.text_batches(whole, "_text", 2 << 20):
                ids, counts = vocab.encode_column(batch.column("_text"))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                order = np.arange(place, place + len(counts))
                place += len(counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), batch.column("_shard"), pa.array(order), pa.array(counts.astype(np.int64)),
                     id_lists(ids, counts, width)],
                    ["_id", "_shard", "_place", "n_tokens", "_ids"],
                )

    return run


def _counter(width: str):
    """How often each id occurs, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column("_ids"), width))
            if len(found) > len(total):
                total = np.append(total, np.zeros(len(found) - len(total), np.int64))
            total[: len(found)] += found
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(total[held])], ["id", "n"])

    return run


def _flat(column, width: str) -> np.ndarray:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(bounds):
        return np.zeros(0, width)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(width)


def _writer(folder: str, frequency, width: str):
    """Writes each row of consecutive documents to one file and lists its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out, next_ = Table.of(frequency.value), None, None
        for batch in batches:
            shard, place = (batch.column(c).to_numpy() for c in ("_shard", "_place"))
            breaks = np.flatnonzero((np.diff(shard) != 0) | (np.diff(place) != 1)) + 1
            for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if out is None or next_ != (shard[a], place[a]):
                    if out is not None:
                        yield out.close()
                    out = Blocks(folder, int(shard[a]), int(place[a]), table)
                part = batch.slice(a, b - a)
                out.add(part.column("_id"), part.column("n_tokens").to_numpy(), _flat(part.column("_ids"), width))
                next_ = (shard[a], place[b - 1] + 1)
        if out is not None:
            yield out.close()

    return run


def write(documents: DataFrame, folder: str, vocabulary_path: str, id: str = "doc_id", text: str = "text",
          end_id: int | None = None) -> None:
    """Encode every text, in ascending order of ``id``, to files in ``folder``.

    Null and empty texts have no ids but the end id. Documents without id come first. Rows of one id
    follow each other in the order of their texts.
    """
    spark = documents.sparkSession
    width = "<u2" if max(vocabulary(vocabulary_path).size, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    docs = documents.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    ranged = docs.repartitionByRange("_id").sortWithinPartitions("_id", "_text").withColumn("_shard", F.spark_partition_id())
    ids = ranged.mapInArrow(_encoder(vocabulary_path, end_id, width), "_id long, _shard int, _place long, n_tokens long, _ids binary")
    ids.write.option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.schema(ids.schema).parquet(f"{folder}/ids")
    # as many numbers as the vocabulary has ids
    held = ids.select("_ids").mapInArrow(_counter(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(held["id"].max()) + 1 if len(held) else 1, np.int64)
    counts[held["id"].to_numpy()] = held["n"].to_numpy()
    frequency = scaled(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequency)], "id long, frequency long").coalesce(1).write.parquet(
        f"{folder}/table"
    )
    shared = spark.sparkContext.broadcast(frequency)
    ids.mapInArrow(
        _writer(f"{folder}/files", shared, width),
        "file string, shard long, first long, offset long, size long, documents long, tokens long",
    ).write.parquet(f"{folder}/manifest")


def _reader(folder: str, frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(frequency.value)
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['file']}") as file:
                    head = file.read_at(len(_MAGIC) + 4, 0)
                    if head != _MAGIC + struct.pack("<I", table.checksum):
                        raise ValueError(f"{row['file']} was written with another table")
                    data = file.read_at(row["size"], row["offset"])
                names, counts, ids = read_block(data, table)
                begin = row["before"] + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(begin.astype(np.int64)), pa.array(counts), id_lists(ids, counts)],
                    ["_id", "start", "n_tokens", "ids"],
                )

    return run


def read(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """Documents of the files: ``id``, ``start`` (ids of all before), ``n_tokens``, ``ids`` (binary).

    Blocks are read and decoded independently, one row of the manifest each. Only one total for each
    shard, that is for each partition of the sort, passes the driver.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    held = spark.read.parquet(f"{folder}/table").toPandas().sort_values("id")
    frequency = spark.sparkContext.broadcast(held["frequency"].to_numpy())
    shards, total = [], 0
    for row in manifest.groupBy("shard").agg(F.sum("tokens").alias("tokens")).orderBy("shard").collect():
        shards.append((row["shard"], total))
        total += row["tokens"]
    begins = spark.createDataFrame(shards, "shard long, begin long")
    earlier = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
    blocks = (
        manifest.withColumn("inner", inner).join(begins, "shard")
        .select("file", "offset", "size", (F.col("begin") + F.col("inner")).alias("before"))
    )
    return one_row_tasks(blocks).mapInArrow(
        _reader(f"{folder}/files", frequency), "_id long, start long, n_tokens long, ids binary"
    ).withColumnRenamed("_id", id)


def one_row_tasks(listed: DataFrame) -> DataFrame:
    """A list of files or blocks, dealt to a task for each row, at most ``MOST_TASKS``."""
    return listed.repartition(max(1, min(listed.count(), MOST_TASKS)))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checksums(documents: DataFrame, id: str = "doc_id") -> DataFrame:
    """Unsigned CRC32 of the ids of each document, beside its place and number of ids."""
    return documents.select(id, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
