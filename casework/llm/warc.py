"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a
footer seek table (a skippable frame that lists the compressed and decompressed size of
every frame). An index table maps a record to its bundle, the number of its frame and its
offset within the decompressed frame, so a reader decompresses one frame per record asked
for, whatever the bundle's size.

Bundles are written by the tasks under names that no other attempt uses. Spark commits the
index, and only bundles in the index exist for readers, so a repeated or lost task leaves
an orphan file at most.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Decompressed bytes of a frame; a larger record has a frame of its own.
FRAME_BYTES = 256 << 10
#: Compressed bytes after which a bundle is closed.
BUNDLE_BYTES = 64 << 20
#: Payloads under this size are never revisits.
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the seekable format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def format_record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit (``refers_to`` given) has the HTTP header of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class BundleWriter:
    """Writes bundles to ``folder``; ``add`` returns where a record went."""

    def __init__(self, folder: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.compress = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self.out = None

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.frames: list[tuple[int, int]] = []
            self.buffer, self.size, self.written = [], 0, 0
        if self.buffer and self.size + len(record) > FRAME_BYTES:
            self._end_frame()
            if self.written >= BUNDLE_BYTES:
                self.close()
                return self.add(record)
        place = self.name, len(self.frames), self.size, len(record)
        self.buffer.append(record)
        self.size += len(record)
        return place

    def _end_frame(self) -> None:
        data = self.compress(b"".join(self.buffer))
        self.out.write(data)
        self.frames.append((len(data), self.size))
        self.written += len(data)
        self.buffer, self.size = [], 0

    def close(self) -> None:
        if self.out is not None:
            if self.buffer:
                self._end_frame()
            table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
            self.out.close()
            self.out = None


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or flags & 0x80:
            raise ValueError(f"{path} has no seek table of the expected form")
        self.file.seek(size - 9 - 8 * n)
        table = self.file.read(8 * n)
        self.starts, at = [], 0
        self.sizes = list(struct.iter_unpack("<II", table))
        for compressed, _ in self.sizes:
            self.starts.append(at)
            at += compressed

    def frame(self, number: int) -> bytes:
        compressed, size = self.sizes[number]
        self.file.seek(self.starts[number])
        return zstandard.ZstdDecompressor().decompress(self.file.read(compressed), max_output_size=max(1, size))

    def close(self) -> None:
        self.file.close()


def _writer(folder: str):
    def write(batches):
        writer = BundleWriter(folder)
        for batch in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                digest = hashlib.sha256(payload).hexdigest()
                out.append((page_id, record_id(page_id), *writer.add(format_record(page_id, url, payload, digest, len(payload), refers_to))))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "record_id", "bundle", "frame", "offset", "length"])
        writer.close()

    return write


def _reader(folder: str):
    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        opened, name, number, data = None, None, None, b""
        for batch in batches:
            out = []
            for bundle, frame, offset, length in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
                if bundle != name:
                    if opened:
                        opened.close()
                    opened, name, number = BundleReader(fs, f"{root}/{bundle}"), bundle, None
                if frame != number:
                    number, data = frame, opened.frame(frame)
                fields, block = parse_record(data[offset : offset + length])
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                header, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if refers is None:
                    size = len(payload)
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not have its digest")
                else:
                    size = int(header.rsplit(b"Content-Length: ", 1)[1])
                    payload = None
                out.append((page and int(page), size, digest, fields["WARC-Type"], refers and int(refers), fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), payload))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*out)) or [[]] * len(kinds)
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "payload"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if opened:
            opened.close()

    return read


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write one WARC record per row and return the index (``page_id, record_id, bundle, frame, offset, length``).

    Of rows with equal payloads of at least 100 bytes the one with the smallest id is the
    response and the others revisit it; smaller payloads are all responses. A null payload
    is empty. Rows without an id count as larger than any id and are never revisited unless
    their payload has no row with an id, in which case all of them are responses. Rows that
    share the smallest id are all responses. Null URLs are left out; bytes outside printable
    ASCII in a URL are percent-encoded. Empty tables give an empty index; other columns are
    ignored, whatever their names.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload)
    digests = scratch.table(rows.filter(F.length("payload") >= REVISIT_BYTES).select("page_id", F.sha2("payload", 256).alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # Written out, so that the planner knows its size: small enough, it is broadcast; else payloads are shuffled by id.
    revisits = scratch.table(digests.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    keyed = rows.withColumn("digest", F.sha2("payload", 256)).join(revisits, ["page_id", "digest"], "left")
    return scratch.table(keyed.select("page_id", "url", "payload", "refers_to").mapInArrow(_writer(folder), INDEX_SCHEMA), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name, each frame decompressed once. ``payload`` is null for revisits."""
    bundles = index.select("bundle").distinct().count()
    placed = index.repartition(max(1, min(4096, 2 * bundles)), "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return placed.mapInArrow(
        _reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, payload binary"
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path("bundles")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, scratch=scratch)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND f < page_id THEN f END AS refers_to
FROM w
"""
