"""WARC archives as seekable Zstandard bundles.

A bundle is one file: frames of whole WARC records, each frame compressed by
itself; a skippable frame with a directory, which says for each record id the
frame and where in the frame's text the record lies; and at the end the seek
table of the public seekable format, which has the sizes of all frames. Any
Zstandard decoder reads the file as one WARC archive, and one record needs one
frame. A record whose payload another record has already is a revisit, without
payload.

Spark writes the files, so a lost task is done again and leaves nothing twice:
a bundle is one row of its text source, whose line end is set to the four bytes
that a seek table ends with. The binary source reads them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, fresh_path, join_counted, load, removed_path, staged

#: Bytes of records after which a frame ends, and of frames after which a bundle ends.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
#: Fixed values of the formats: skippable frames, the seek table's own, and the table's last four bytes.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_END = b"\xb1\xea\x92\x8f"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = re.compile(rb"<urn:page:(-?\d+|none):([A-Z2-7]{32})>")


def base32_sha1(text: Column) -> Column:
    """SHA-1 of UTF-8 text in base 32, in upper case; 40 hex digits are four times ten, which are eight of base 32."""
    digits = F.sha1(text)
    part = lambda k: F.translate(F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*map(part, range(4)))


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_digest, refers_to, is_response): which records are responses and which revisit one.

    Of records with equal payloads of at least `least` bytes that with the
    largest page_id is the response; smaller ones all are. Null html is the
    empty payload. Rows that repeat the largest page_id are responses; one
    without a page_id is one only if no other has its payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("html")))
    groups = staged(rows.groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("copies")), "payloads")
    own = (F.octet_length("html") < least) | F.col("page_id").eqNullSafe(F.col("largest"))
    return join_counted(rows, groups, ["payload_digest"], "copies").select("page_id", "url", "html", "payload_digest", F.when(~own, F.col("largest")).alias("refers_to"), own.alias("is_response"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def safe_uri(url: str) -> str:
    """A URL without what could end a header line: white space, controls and characters beyond ASCII become their bytes in percent form."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_response: bool, date: str) -> bytes:
    """One record, byte for byte the same however often it is written."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", *([f"WARC-Target-URI: {safe_uri(url)}"] if url else []),
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if is_response else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Gathers records into frames, and frames into a bundle with its directory and seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.size = [], [], 0
        self.held, self.held_size = [], 0
        self.ids, self.at = [], []

    def add(self, name: bytes, record: bytes) -> None:
        self.ids.append(name)
        self.at.append((len(self.frames), self.held_size, len(record)))
        self.held.append(record)
        self.held_size += len(record)
        if self.held_size >= self.frame_bytes:
            self._end_frame()

    def _end_frame(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held_size))
            self.size += len(frame)
            self.held, self.held_size = [], 0

    def finish(self) -> bytes:
        """The whole file."""
        self._end_frame()
        at = np.array(self.at, "<u4").reshape(-1, 3)
        held = np.array([len(x) for x in self.ids], "<u4").tobytes() + at.T.tobytes() + b"".join(self.ids)
        directory = len(self.ids).to_bytes(4, "little") + self.zstd.compress(held)
        directory = SKIPPABLE.to_bytes(4, "little") + len(directory).to_bytes(4, "little") + directory
        entries = np.array([*self.sizes, (len(directory), 0)], "<u4").tobytes()
        foot = (len(self.sizes) + 1).to_bytes(4, "little") + b"\0" + SEEK_END
        return b"".join([*self.frames, directory, SEEK_TABLE.to_bytes(4, "little"), (len(entries) + len(foot)).to_bytes(4, "little"), entries, foot])


class Bundle:
    """A bundle's bytes, read by its seek table."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if bytes(self.data[-4:]) != SEEK_END:
            raise ValueError("no seek table at the end")
        n = int.from_bytes(self.data[-9:-5], "little")
        wide = 12 if self.data[-5] & 0x80 else 8  # with checksums
        table = np.frombuffer(self.data[len(data) - 9 - n * wide : len(data) - 9], "<u4").reshape(n, wide // 4)
        self.ends, self.raw = np.cumsum(table[:, 0].astype(np.int64)), table[:, 1]
        d = self.data[self.ends[-2] if n > 1 else 0 : self.ends[-1]]
        if int.from_bytes(d[:4], "little") != SKIPPABLE:
            raise ValueError("no directory")
        count = int.from_bytes(d[8:12], "little")
        held = zstandard.ZstdDecompressor().decompress(d[12:])
        numbers = np.frombuffer(held, "<u4", 4 * count).reshape(4, count).astype(np.int64)
        stops = 16 * count + np.cumsum(numbers[0])
        self.ids = [held[b - n : b] for n, b in zip(numbers[0].tolist(), stops.tolist())]
        self.frame, self.offset, self.length = numbers[1], numbers[2], numbers[3]

    def text(self, frame: int) -> bytes:
        """A frame's records; no other frame is read."""
        return zstandard.ZstdDecompressor().decompress(self.data[self.ends[frame - 1] if frame else 0 : self.ends[frame]])

    def records(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, memoryview]]:
        """Each record (of those numbers, if given) with its number in the directory."""
        now, text = -1, b""
        for k in range(len(self.ids)) if wanted is None else sorted(wanted):
            if self.frame[k] != now:
                now = int(self.frame[k])
                text = memoryview(self.text(now))
            yield k, text[self.offset[k] : self.offset[k] + self.length[k]]


def parsed(record: memoryview) -> tuple[dict[bytes, bytes], dict[bytes, bytes], memoryview]:
    """WARC headers, HTTP headers and payload of a record; names are in lower case."""

    def headers(data: memoryview) -> tuple[dict[bytes, bytes], memoryview]:
        end, seen = -1, 1024
        while end < 0:
            end = bytes(data[:seen]).find(b"\r\n\r\n")
            if end < 0 and seen >= len(data):
                raise ValueError("headers without an end")
            seen *= 4
        lines = bytes(data[:end]).split(b"\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}, data[end + 4 :]

    warc, rest = headers(record)
    n = int(warc[b"content-length"])
    if bytes(rest[n:]) != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, payload = headers(rest[:n])
    return warc, http, payload


def write_bundles(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Writes marked() records as bundles into a new folder, some for each partition. A task holds one bundle and one record."""

    def run(batches):
        out = BundleWriter(frame_bytes)
        full = lambda: pa.RecordBatch.from_arrays([pa.array([out.finish()[: -len(SEEK_END)]], pa.binary())], names=["bundle"])
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, refers_to, is_response = (c[k].as_py() for c in batch.columns)
                payload = html.encode()
                out.add(record_id(page_id, digest)[1:-1].encode(), warc_record(page_id, url, payload, digest, refers_to, is_response, date))
                if out.size >= bundle_bytes:
                    yield full()
                    out = BundleWriter(frame_bytes)
        if out.ids:
            yield full()

    rows = records.select("page_id", "url", "html", "payload_digest", "refers_to", "is_response").mapInArrow(run, "bundle binary")
    spark = records.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # a line's end is the end of the seek table; one line a file
        text = rows.select(F.col("bundle").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", SEEK_END.decode("latin-1"))
        text.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    finally:
        spark.conf.set(CLEANUP, before)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where each record lies, offset and length in the frame's text. No frame of records is decompressed."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = Bundle(batch.column(1)[k].as_buffer())
                n = len(b.ids)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in b.ids], pa.string()), pa.array([batch.column(0)[k].as_py()] * n, pa.string()), *(pa.array(x, pa.int64()) for x in (b.frame, b.offset, b.length))], names=["record_id", "bundle", "frame", "offset", "length"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "record_id string, bundle string, frame long, offset long, length long")


def fetch(spark: SparkSession, index: DataFrame, ids: DataFrame) -> DataFrame:
    """(record_id, record) of the wanted ids (column record_id), whole WARC records. Only bundles with a wanted record are read, and of them only frames with one.

    index: record_index(), or a table of it. An id that isn't there has no row;
    one that is wanted twice has one row for each place it is stored in.
    """
    found = staged(index.join(ids.select("record_id").distinct(), "record_id", "left_semi"), "wanted")
    per = found.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("records"))
    # paths of files come to the driver, as they do for any file listing
    paths = [r.bundle for r in found.select("bundle").distinct().collect()]
    schema = "record_id string, record binary"
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b, wanted, names, out = Bundle(batch.column(0)[k].as_buffer()), {}, [], []
                for r in batch.column(1)[k].as_py():
                    wanted.setdefault(r["frame"], []).append(r)
                for frame, rs in sorted(wanted.items()):
                    text = b.text(frame)
                    for r in rs:
                        names.append(r["record_id"])
                        out.append(text[r["offset"] : r["offset"] + r["length"]])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["record_id", "record"])

    files = spark.read.format("binaryFile").load(paths)
    return files.join(per, files.path == per.bundle).select("content", "records").mapInArrow(run, schema)


def read_bundles(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """Every record as it is read back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, frame, offset (and payload).

    A response's length and digest are those of its payload as it lies there,
    and must agree with its headers; a revisit's come from its headers.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, frame long, offset long" + (", payload binary" if keep_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    number = lambda x: None if x == b"none" else int(x)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                bundle, rows, size = Bundle(batch.column(0)[k].as_buffer()), [], 0
                for j, record in bundle.records():
                    warc, http, payload = parsed(record)
                    kind, said, n = warc[b"warc-type"].decode(), warc[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), int(http[b"content-length"])
                    own = ID.fullmatch(warc[b"warc-record-id"])
                    if own is None or own[0][1:-1] != bundle.ids[j]:
                        raise ValueError("the directory names another record")
                    refers = ID.fullmatch(warc[b"warc-refers-to"]) if kind == "revisit" else None
                    if kind == "response" and (n != len(payload) or said != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"a payload is not what its record says: {own[0]!r}")
                    row = (number(own[1]), warc.get(b"warc-target-uri", b"").decode() or None, n, said, kind, number(refers[1]) if refers else None, int(bundle.frame[j]), int(bundle.offset[j]))
                    rows.append((*row, bytes(payload) if kind == "response" else None) if keep_payload else row)
                    size += len(payload) if keep_payload else 0
                    if len(rows) >= 4096 or size >= 16 * FRAME_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0, **sizes) -> DataFrame:
    """Writes all pages as bundles and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; nulls in url leave its header out; a row
    without a page_id has the record id `none`; rows that repeat are written
    each by itself; other columns are ignored; an empty table gives no rows.
    The bundles go into the shared folder and are deleted when all is read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "bundles")
    write_bundles(marked(pages, least), path, **sizes)
    out = staged(read_bundles(spark, path).drop("url", "frame", "offset"), "records")
    removed_path(spark, path)
    return out


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_trip() of all pages, payloads of any size revisited; null html is an empty payload, an empty table gives no rows."""
    return round_trip(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (5 * (7 - i % 8))) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM q
"""
