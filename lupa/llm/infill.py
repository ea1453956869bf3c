"""Fill-in-middle transformation on texts kept in seekable Zstandard frames.

``store`` writes texts to bundles. A bundle is a row of independent frames of at most ``FRAME`` code points
each; texts lie in them one after the other, short ones share a frame and long ones span many. The seek
table at its end has packed size, bytes and code points of each frame, so their running sums tell which
frame holds any code point; a directory names the texts with the places of their first byte and code
point. Bundle layout (little-endian)::

    frames | directory, packed | seek table | numbers and sizes of both (u8) | magic "UNITS1\\0\\0"

``transform`` reads the bundles, one task each. It decompresses the frames that hold the two cuts of a text
to find their bytes, then copies the parts, frame by frame, in the new order to bundles of its own. ``read``
takes those, finds the marks that part the text and streams the parts in the old order again. No task
holds more than some frames and one directory of at most ``BUNDLE_TEXTS`` texts; texts are never whole in memory but in the row they come
from. Bundles count once the table written beside them lists them: a task that is run again leaves an
unlisted file, and reading is by file, so lost executors cost the files they were at.

The cuts of a text depend on its id alone (``numbers``): the first lies after ``min`` and the second after
``max`` of two hashed places in the text, as code points. Texts that are empty or hold a mark, and a share of
the others, stay ``plain``. A null text is empty. A null id is hashed as an empty one; rows that repeat an
id are texts of their own, with cuts of the same hash. Very long texts differ in nothing but the number of
their frames. An empty table gives no bundles and an empty result. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa.llm import words as W
from lupa.llm.token_files import one_row_tasks, open_folder

FRAME = 1 << 16
BUNDLE = 1 << 25
BUNDLE_TEXTS = 1 << 18
LEVEL = 3

# Fixed values of the format of transformed texts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_PLAIN_FROM, _SPM_BELOW = 90, 20

_MAGIC = b"UNITS1\0\0"
_TAIL = struct.Struct("<QQQ")
_FRAME = struct.Struct("<III")
_TEXT = struct.Struct("<q?QQQQB")  # id, known, first byte, bytes, first code point, code points, form
_FORMS = (PLAIN, PSM, SPM)
_MARK = 3  # bytes of a mark
_KEPT = 4  # frames kept decompressed


def numbers(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of the hash of an id."""
    name = "" if doc_id is None else str(doc_id)
    return struct.unpack(">IIII", hashlib.sha256(f"1:{name}".encode()).digest()[:16])


def places(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form of a text of ``n`` code points and where its prefix and its middle end."""
    h1, h2, h3, h4 = numbers(doc_id)
    if not n or marked or h3 % 100 >= _PLAIN_FROM:
        return PLAIN, 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < _SPM_BELOW else PSM, a, b


def _begins(data: np.ndarray) -> np.ndarray:
    """Where code points begin in UTF-8."""
    return (data & 0xC0) != 0x80


class Writer:
    """One bundle of frames."""

    def __init__(self, folder: str, level: int = LEVEL, frame: int = FRAME):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        self.name = f"units-{uuid.uuid4().hex}.zst"
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.frames, self.texts = frame, bytearray(), bytearray()
        self.held, self.held_units, self.bytes, self.units, self.count = [], 0, 0, 0, 0

    def begin(self, doc_id: int | None, form: str = PLAIN) -> None:
        self.text = (doc_id or 0, doc_id is not None, self.bytes, self.units, _FORMS.index(form))

    def put(self, data: bytes) -> None:
        """A part of the text; parts end between code points."""
        units = None
        at = 0
        while at < len(data):
            room = self.frame - self.held_units
            if len(data) - at <= room:  # no more code points than bytes
                part = data[at:] if at else data
            else:
                if units is None:
                    units = np.flatnonzero(_begins(np.frombuffer(data, np.uint8)))
                first = int(np.searchsorted(units, at))
                part = data[at : units[first + room]] if first + room < len(units) else data[at:]
            count = int(np.count_nonzero(_begins(np.frombuffer(part, np.uint8))))
            self.held.append(part)
            self.held_units += count
            self.bytes += len(part)
            self.units += count
            at += len(part)
            if self.held_units >= self.frame:
                self._flush()

    def end(self) -> None:
        doc_id, known, first_byte, first_unit, form = self.text
        self.texts += _TEXT.pack(doc_id, known, first_byte, self.bytes - first_byte, first_unit, self.units - first_unit, form)
        self.count += 1

    def _flush(self) -> None:
        if self.held:
            whole = b"".join(self.held)
            packed = self.packer.compress(whole)
            self.file.write(packed)
            self.frames += _FRAME.pack(len(packed), len(whole), self.held_units)
            self.held, self.held_units = [], 0

    def close(self) -> dict:
        self._flush()
        directory = self.packer.compress(bytes(self.texts))
        self.file.write(directory + bytes(self.frames) + _TAIL.pack(len(directory), len(self.frames), len(self.texts)) + _MAGIC)
        self.file.close()
        return {"bundle": self.name, "texts": self.count, "units": self.units, "bytes": self.bytes}


class Reader:
    """Random access to a bundle by byte and by code point."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size, tail = self.file.size(), _TAIL.size + len(_MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[-len(_MAGIC) :] != _MAGIC:
            raise ValueError(f"{name} is no bundle of texts")
        directory, table, self._listed = _TAIL.unpack_from(end)
        held = self.file.read_at(directory + table, size - tail - directory - table)
        self._directory = held[:directory]
        frames = list(_FRAME.iter_unpack(held[directory:]))
        self.packed = [f[0] for f in frames]
        self.offset = list(accumulate(self.packed, initial=0))
        self.first_byte = list(accumulate((f[1] for f in frames), initial=0))
        self.first_unit = list(accumulate((f[2] for f in frames), initial=0))
        self._open: dict[int, bytes] = {}
        self.unpacked = 0

    def close(self) -> None:
        self.file.close()

    def texts(self) -> Iterator[tuple]:
        """Id, first byte, bytes, first code point, code points and form of each text."""
        held = zstandard.ZstdDecompressor().decompress(self._directory, max_output_size=self._listed) if self._listed else b""
        for doc_id, known, byte, size, unit, units, form in _TEXT.iter_unpack(held):
            yield doc_id if known else None, byte, size, unit, units, _FORMS[form]

    def whole_frame(self, i: int) -> bytes:
        data = self._open.pop(i, None)
        if data is None:
            size = self.first_byte[i + 1] - self.first_byte[i]
            packed = self.file.read_at(self.packed[i], self.offset[i])
            data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
            self.unpacked += 1
        self._open[i] = data
        if len(self._open) > _KEPT:
            del self._open[next(iter(self._open))]
        return data

    def byte_of(self, unit: int) -> int:
        """The byte where a code point begins; its frame alone is decompressed."""
        if unit == self.first_unit[-1]:
            return self.first_byte[-1]
        i = bisect_right(self.first_unit, unit) - 1
        inner = unit - self.first_unit[i]
        if self.first_byte[i + 1] - self.first_byte[i] == self.first_unit[i + 1] - self.first_unit[i]:
            return self.first_byte[i] + inner
        data = np.frombuffer(self.whole_frame(i), np.uint8)
        return self.first_byte[i] + int(np.flatnonzero(_begins(data))[inner])

    def stream(self, start: int, end: int) -> Iterator[bytes]:
        """The bytes from ``start`` to ``end``, frame by frame."""
        i = bisect_right(self.first_byte, start) - 1
        while start < end:
            data, base = self.whole_frame(i), self.first_byte[i]
            yield data[start - base : end - base]
            start = self.first_byte[i + 1]
            i += 1

    def find(self, mark: bytes, start: int, end: int) -> int:
        """The first place of a mark, also where it lies across two frames."""
        at, rest = start, b""
        for part in self.stream(start, end):
            found = (rest + part).find(mark)
            if found >= 0:
                return at - len(rest) + found
            at += len(part)
            rest = (rest + part)[1 - len(mark) :]
        raise ValueError("a transformed text has lost a mark")


def _store(folder: str, level: int, frame: int, bundle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for whole in batches:
            for batch in W.text_batches(whole, "_text"):
                for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").cast(pa.large_binary()), strict=True):
                    if out is None:
                        out = Writer(folder, level, frame)
                    out.begin(doc_id)
                    out.put(text.as_py() or b"")
                    out.end()
                    if out.bytes >= bundle or out.count >= BUNDLE_TEXTS:
                        yield pa.RecordBatch.from_pylist([out.close()], _LISTED)
                        out = None
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close()], _LISTED)

    return run


_LISTED = pa.schema([("bundle", pa.string()), ("texts", pa.int64()), ("units", pa.int64()), ("bytes", pa.int64())])
_LISTED_SQL = "bundle string, texts long, units long, bytes long"


def store(documents: DataFrame, folder: str, id: str = "doc_id", text: str = "text", level: int = LEVEL,
          frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Write every text to bundles in ``folder/bundles``, listed in the table ``folder/index``."""
    rows = documents.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows.mapInArrow(_store(f"{folder}/bundles", level, frame, bundle), _LISTED_SQL).write.parquet(f"{folder}/index")


def _marked(bundle: Reader, start: int, end: int) -> bool:
    rest = b""
    for part in bundle.stream(start, end):
        held = rest + part
        if any(mark in held for mark in (PREFIX, SUFFIX, MIDDLE)):
            return True
        rest = held[1 - _MARK :]
    return False


def _transform(source: str, target: str, level: int, frame: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                bundle, out = Reader(source, name), Writer(target, level, frame)
                for doc_id, byte, size, unit, units, _ in bundle.texts():
                    end = byte + size
                    form, a, b = places(doc_id, units, _marked(bundle, byte, end))
                    if form == PLAIN:
                        order = [(b"", byte, end)]
                    else:
                        first, second = bundle.byte_of(unit + a), bundle.byte_of(unit + b)
                        parts = {PREFIX: (byte, first), SUFFIX: (second, end), MIDDLE: (first, second)}
                        marks = (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE)
                        order = [(mark, *parts[mark]) for mark in marks]
                    out.begin(doc_id, form)
                    for mark, start, stop in order:
                        out.put(mark)
                        for part in bundle.stream(start, stop):
                            out.put(part)
                    out.end()
                bundle.close()
                yield pa.RecordBatch.from_pylist([out.close()], _LISTED)

    return run


def transform(spark: SparkSession, folder: str, target: str, level: int = LEVEL, frame: int = FRAME) -> None:
    """Write the transformed texts of the bundles in ``folder`` to bundles in ``target``, one for one."""
    listed = spark.read.parquet(f"{folder}/index").select("bundle")
    found = one_row_tasks(listed).mapInArrow(_transform(f"{folder}/bundles", f"{target}/bundles", level, frame), _LISTED_SQL)
    found.write.parquet(f"{target}/index")


def parts_of(bundle: Reader, byte: int, size: int, form: str) -> list[tuple[int, int]]:
    """Byte ranges of prefix, middle and suffix of a transformed text, found by its marks."""
    end = byte + size
    if form == PLAIN:
        return [(byte, end), (end, end), (end, end)]
    second, last = (SUFFIX, MIDDLE) if form == PSM else (PREFIX, MIDDLE)
    head = byte + _MARK
    at = bundle.find(second, head, end)
    to = bundle.find(last, at + _MARK, end)
    one, two, middle = (head, at), (at + _MARK, to), (to + _MARK, end)
    return [one, middle, two] if form == PSM else [two, middle, one]


def _units(pieces: Iterator[bytes], *sums) -> int:
    """Code points of a stream, which is also fed to the sums."""
    total = 0
    for piece in pieces:
        for s in sums:
            s.update(piece)
        total += int(np.count_nonzero(_begins(np.frombuffer(piece, np.uint8))))
    return total


_READ = pa.schema([
    ("_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
])
_READ_SQL = "_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                bundle, rows = Reader(folder, name), []
                for doc_id, byte, size, _, _, form in bundle.texts():
                    output, restored = hashlib.sha256(), hashlib.sha256()
                    for part in bundle.stream(byte, byte + size):
                        output.update(part)
                    prefix, middle, suffix = (_units(bundle.stream(*x), restored) for x in parts_of(bundle, byte, size, form))
                    known = form != PLAIN
                    rows.append((
                        doc_id, prefix + middle + suffix, form, prefix if known else None, middle if known else None,
                        output.hexdigest(), restored.hexdigest(),
                    ))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                bundle.close()
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)


def read(spark: SparkSession, folder: str, id: str = "doc_id") -> DataFrame:
    """Digests of the transformed texts in ``folder`` and of the texts rebuilt from them."""
    listed = spark.read.parquet(f"{folder}/index").select("bundle")
    return one_row_tasks(listed).mapInArrow(_digests(f"{folder}/bundles"), _READ_SQL).withColumnRenamed("_id", id)


def _texts(folder: str, rebuilt: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                bundle = Reader(folder, name)
                for doc_id, byte, size, _, _, form in bundle.texts():
                    ranges = parts_of(bundle, byte, size, form) if rebuilt else [(byte, byte + size)]
                    text = b"".join(part for x in ranges for part in bundle.stream(*x)).decode()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id], pa.int64()), pa.array([form]), pa.array([text], pa.string())], ["_id", "form", "text"]
                    )
                bundle.close()

    return run


def texts(spark: SparkSession, folder: str, rebuilt: bool = False, id: str = "doc_id") -> DataFrame:
    """The texts of a folder as they are, or ``rebuilt`` in the old order, for training or for a look."""
    listed = spark.read.parquet(f"{folder}/index").select("bundle")
    return one_row_tasks(listed).mapInArrow(_texts(f"{folder}/bundles", rebuilt), "_id long, form string, text string").withColumnRenamed("_id", id)
