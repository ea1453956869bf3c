"""Web archives (WARC) in seekable Zstandard bundles.

Each page becomes a WARC record. Records are grouped into frames of about ``FRAME`` bytes that are
compressed on their own; a bundle is a file of such frames, closed by a seek table in a skippable
frame (sizes of all frames, and a magic number at the very end), which ordinary Zstandard readers pass
over. The dataset ``index`` maps each record to bundle, frame and offset in the frame, so one record is
read by decompressing one frame.

Of records with equal payloads of at least ``REVISIT`` bytes, that with the largest id holds the
payload and the others are revisits that name it; these carry no payload. Smaller payloads are always
held. A null payload is empty. Records of equal id and payload all hold it. A record without id is
never named by others unless none of its copies has an id. Bundles count once they are in the index: a
task that is run again leaves an unlisted file. A very long payload fills a frame of its own. An empty table gives an
empty index. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa.llm.token_files import one_row_tasks, open_folder

REVISIT = 1000
FRAME = 256 << 10
BUNDLE = 32 << 20

# Names and numbers of the two formats.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_INDEX = "record string, page_id long, bundle string, frame int, offset int, size int"

_DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = _DATE) -> tuple[str, bytes]:
    """Id and bytes of a record; ``digest`` is the hexadecimal SHA-1 of the payload."""
    name = _name(page_id) if page_id is not None else f"urn:x-page:none:{digest}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shown = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{shown}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_name(refers_to)}>")]
        block = http
    else:
        block = http + payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return name, _VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def _name(page_id: int) -> str:
    return f"urn:x-page:{page_id}"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at ``at``, and where the next begins."""
    if not data.startswith(_VERSION, at):
        raise ValueError("no record starts here")
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at + len(_VERSION) : end].decode().split("\r\n"))
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    block = data[begin:stop]
    return head, block[block.index(b"\r\n\r\n") + 4 :], stop + 4


class Bundle:
    """One file of frames."""

    def __init__(self, folder: str, level: int):
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.file = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.listed, self.held, self.size, self.total = [], [], [], 0, 0

    def add(self, name: str, page_id: int | None, data: bytes) -> None:
        self.listed.append((name, page_id, self.name, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        packed = self.packer.compress(b"".join(self.held))
        self.file.write(packed)
        self.frames.append((len(packed), self.size))
        self.total += self.size
        self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in frames) + _FOOTER.pack(len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Place, packed and whole size of each frame."""
    size = file.size()
    count, flags, magic = _FOOTER.unpack(file.read_at(_FOOTER.size, size - _FOOTER.size))
    if magic != _SEEKABLE or flags:
        raise ValueError("the file has no seek table")
    table = file.read_at(8 * count, size - _FOOTER.size - 8 * count)
    out, at = [], 0
    for packed, whole in struct.iter_unpack("<II", table):
        out.append((at, packed, whole))
        at += packed
    return out


def _write(folder: str, level: int):
    def rows(bundle: Bundle) -> pa.RecordBatch:
        columns = list(zip(*bundle.listed, strict=True))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        bundle.listed = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["record", "page_id", "bundle", "frame", "offset", "size"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle is None:
                    bundle = Bundle(folder, level)
                bundle.add(*_placed(page_id, url, payload, digest, refers))
                if bundle.total >= BUNDLE:
                    bundle.close()
                    yield rows(bundle)
                    bundle = None
        if bundle is not None:
            bundle.close()
            yield rows(bundle)

    return run


def _placed(page_id, url, payload, digest, refers):
    name, data = record(page_id, url, payload, digest, refers)
    return name, page_id, data


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", level: int = 3) -> None:
    """Write every page to bundles in ``folder/bundles`` and their index to ``folder/index``."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("long").alias("_id"), F.col(url).alias("_url"), body.alias("_body")).withColumn("_digest", F.sha1("_body"))
    large = F.octet_length("_body") >= REVISIT
    held = (
        rows.filter(large).groupBy("_digest").agg(F.max("_id").alias("_held"), F.count("*").alias("_n")).filter("_n > 1")
        .select(F.col("_digest").alias("_same"), "_held")
    )
    named = rows.join(held, large & (F.col("_digest") == F.col("_same")), "left")
    refers = F.when(F.coalesce(F.col("_id") != F.col("_held"), F.col("_held").isNotNull()), F.col("_held"))
    ready = named.select("_id", "_url", "_body", "_digest", refers.alias("_refers"))
    ready.mapInArrow(_write(f"{folder}/bundles", level), _INDEX).write.parquet(f"{folder}/index")


def _read_frames(folder: str):
    """Every record of the listed bundles, with the payload's own digest compared with the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as file:
                    for at, packed, whole in read_seek_table(file):
                        data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=whole)
                        yield _records(data)

    return run


def _records(data: bytes) -> pa.RecordBatch:
    out, at = [], 0
    while at < len(data):
        head, payload, at = parsed(data, at)
        out.append(_shown(head, payload))
    return pa.RecordBatch.from_pylist(out, _SHOWN)


def _shown(head: dict[str, str], payload: bytes) -> dict:
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = head["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{head['WARC-Record-ID']} is damaged")
    return {
        "page_id": _number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": kind, "payload_digest": digest,
        "refers_to": _number(head["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


_SHOWN = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()),
])
_SHOWN_SQL = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"


def _number(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:x-page:")
    return None if number.startswith("none:") else int(number)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records: ``page_id``, ``url``, ``record_type``, ``payload_digest``, ``refers_to`` and, for
    responses, ``payload``. Bundles are read independently."""
    bundles = spark.read.parquet(f"{folder}/index").select("bundle").distinct()
    return one_row_tasks(bundles).mapInArrow(_read_frames(f"{folder}/bundles"), _SHOWN_SQL)


def _read_placed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with system.open_input_file(f"{path}/{row['bundle']}") as file:
                    at, packed, whole = read_seek_table(file)[row["frame"]]
                    data = zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=whole)
                head, payload, _ = parsed(data[row["offset"] : row["offset"] + row["size"]])
                out.append(_shown(head, payload))
            yield pa.RecordBatch.from_pylist(out, _SHOWN)

    return run


def fetch(spark: SparkSession, folder: str, ids: DataFrame, id: str = "page_id") -> DataFrame:
    """The records of the given ids, each from its own frame."""
    wanted = ids.select(F.col(id).cast("long").alias("page_id")).distinct()
    found = spark.read.parquet(f"{folder}/index").join(wanted, "page_id", "left_semi")
    return found.select("bundle", "frame", "offset", "size").mapInArrow(_read_placed(f"{folder}/bundles"), _SHOWN_SQL)


def payload_sizes(records: DataFrame) -> DataFrame:
    """The records with ``payload_bytes``: of revisits, the size of the payload they refer to, whose
    digest must agree."""
    flat = records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("_own"))
    held = (
        flat.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("_at"), F.col("payload_digest").alias("_digest")).agg(F.max("_own").alias("_size"))
    )
    named = flat.join(held, (F.col("refers_to") == F.col("_at")) & (F.col("payload_digest") == F.col("_digest")), "left")
    size = F.when(F.col("record_type") == "response", F.col("_own")).otherwise(
        F.coalesce("_size", F.raise_error(F.lit("a revisit refers to no response of its digest")).cast("long"))
    )
    return named.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
