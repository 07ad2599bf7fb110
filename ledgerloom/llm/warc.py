"""Operator 7: WARC archives in seekable Zstandard bundles.

Records are grouped into frames that can be decompressed alone; a bundle ends with a skippable frame that holds the sizes
of all frames (the published seekable format), and an index maps each record to bundle, frame and place in the frame.
Each attempt of a task writes files of its own name; only the files of the attempt that succeeded are in
the index, which is a table in the shared folder, so lost executors leave at most unread files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, small_batches

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
LEAST_REVISIT = 1000
#: Packed bytes that one task reads back.
TASK_BYTES = 2 << 20
#: Up to this many repeated payloads (about 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_PAYLOADS = 200_000
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "page_id bigint, bundle string, frame int, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record: the whole response, or a revisit that holds the header only."""
    name = "none" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {date}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page_id, payload bytes, digest, type, refers_to, payload); the digest of a response is worked out from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda s: None if s == "none" else int(s)
    page_id = number(fields["WARC-Record-ID"][len("<urn:page:") : -1])
    if fields["WARC-Type"] == "revisit":
        return page_id, size, digest, "revisit", number(fields["WARC-Refers-To"][len("<urn:page:") : -1]), b""
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record of page {page_id} is damaged")
    return page_id, size, digest, "response", None, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the end of a file."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    found, at = [], 0
    for c, d in struct.iter_unpack("<II", source.read(8 * n)):
        found.append((at, c, d))
        at += c
    return found


class _Bundles:
    """Writer of bundles into a folder; gives index rows for what it has written."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        import pyarrow.fs
        import zstandard

        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.zstd, self.folder = zstandard.ZstdCompressor(level=3), folder
        self.sink, self.pending, self.held = None, [], 0
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes

    def add(self, page_id: int | None, raw: bytes) -> list[tuple]:
        self.pending.append((page_id, raw))
        self.held += len(raw)
        return self.frame() if self.held >= self.frame_bytes else []

    def frame(self) -> list[tuple]:
        if not self.pending:
            return []
        if self.sink is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.sink, self.frames, self.at, self.raw = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0, 0
        packed, rows, place = self.zstd.compress(b"".join(r for _, r in self.pending)), [], 0
        self.sink.write(packed)
        for page_id, r in self.pending:
            rows.append((page_id, f"{self.folder}/{self.name}", len(self.frames), self.at, len(packed), place, len(r)))
            place += len(r)
        self.frames.append((len(packed), place))
        self.at, self.raw = self.at + len(packed), self.raw + place
        self.pending, self.held = [], 0
        if self.raw >= self.bundle_bytes:
            self.close()
        return rows

    def close(self) -> None:
        if self.sink is not None:
            self.sink.write(seek_table(self.frames))
            self.sink.close()
            self.sink = None


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [c.strip().split(" ") for c in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _write(folder: str, date: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Bundles(folder, frame_bytes, bundle_bytes)
        for batch in slices(batches, "html"):
            done = []
            for page_id, url, html, digest, keep, revisit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                done += out.add(page_id, record(page_id, url, html.encode("utf-8"), digest, keep, revisit, date))
            if done:
                yield _rows(done, _INDEX)
        done = out.frame()
        out.close()
        if done:
            yield _rows(done, _INDEX)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records by their index rows, sorted by bundle and frame: a frame is read once."""
    import pyarrow.fs
    import zstandard

    unzip, opened, held = zstandard.ZstdDecompressor(), None, None
    for batch in batches:
        done = []
        for bundle, frame, offset, size, start, length in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
            if opened is None or opened[0] != bundle:
                if opened:
                    opened[1].close()
                fs, path = pyarrow.fs.FileSystem.from_uri(bundle)
                source = fs.open_input_file(path)
                opened, held = (bundle, source, read_seek_table(source, source.size())), None
            if held is None or held[0] != frame:
                at, packed, whole = opened[2][frame]
                if (at, packed) != (offset, size):
                    raise ValueError(f"{bundle}: index and seek table differ at frame {frame}")
                opened[1].seek(at)
                held = frame, unzip.decompress(opened[1].read(packed), max_output_size=whole)
            done.append(parse(held[1][start : start + length])[:5])
        yield _rows(done, _RECORD)
    if opened:
        opened[1].close()


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record for each row into bundles under ``folder`` (default: the shared folder); returns the index.

    Of rows with equal payloads of at least 1000 bytes the one with the largest id is a response and the others revisit it; all
    smaller ones are responses. Null html is an empty payload, a null url an empty one. A row with a null id revisits where
    its payload is known, else it is a response. Rows that repeat id and payload are the same record, written each. A very
    long payload has a frame of its own. An empty table writes no bundle and gives an empty index; other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    if folder is None:
        import pyarrow.fs

        folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    known = materialize(rows.where(f"size >= {LEAST_REVISIT}").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 AND keep IS NOT NULL").select("digest", "keep"), "payloads")
    few = known.count() <= BROADCAST_PAYLOADS
    joined = rows.join(F.broadcast(known) if few else known, "digest", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id"))
    joined = joined.select("page_id", "url", "html", "digest", "keep", revisit.alias("revisit"))
    return materialize(joined.mapInArrow(_write(folder, date, frame_bytes, bundle_bytes), _INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the index, read from the bundles.

    Frames are dealt to tasks by their bytes, not by those of the index: a bundle, which frames make seekable, is read by several.
    An empty index gives no rows; a record whose payload doesn't have its digest raises.
    """
    packed = index.select("bundle", "frame", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    tasks = max(1, -(-packed // TASK_BYTES))
    return index.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame", "record_offset").mapInArrow(_read, _RECORD)
