"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is a run of frames and, as a skippable
frame at its end, a seek table with each frame's compressed and plain size, so that any Zstandard reader can read the
whole and a seeking one can find a frame without what comes before. An index maps each record's identifier to its frame
and its place in the frame's plain bytes; one record is read by decompressing one frame.

Of pages with equal payloads, of a least size, one is archived as a response and the others as revisits of it.

Bundles are binary cells of a table, of a bounded size each, so that any store that Spark writes to can hold them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow, arrow_map, cut, join_bounded, scratch_path

LEAST = 1000  # bytes of a payload that may be revisited
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
LEVEL = 3
BROADCAST_PAYLOADS = 500_000
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2024-01-01T00:00:00Z"

INDEX = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
BUNDLE = pa.schema([("data", pa.binary()), ("index", INDEX)])
BUNDLE_SQL = "data binary, index array<struct<record_id string, frame int, offset int, length int>>"


class BundleWriter:
    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.open, self.held, self.total = [], 0, 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.frames), "offset": self.held, "length": len(record)})
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            self.frames.append(self.packer.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.total += len(self.frames[-1])
            self.open, self.held = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(table)), table]), self.index


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame."""
    count, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if descriptor & 0x80 else 8
    at, out = len(data) - 9 - count * width, []
    if struct.unpack("<II", data[at - 8 : at]) != (SKIPPABLE, count * width + 9):
        raise ValueError("the seek table is damaged")
    start = 0
    for i in range(count):
        packed, plain = struct.unpack("<II", data[at + i * width : at + i * width + 8])
        out.append((start, packed, plain))
        start += packed
    return out


def read_record(data: bytes, index: list, record_id: str) -> bytes:
    """One record of a bundle, from its own frame alone."""
    entry = next(e for e in index if e["record_id"] == record_id)
    start, packed, plain = seek_table(data)[entry["frame"]]
    frame = zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=plain)
    return frame[entry["offset"] : entry["offset"] + entry["length"]]


def record_name(page_id, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None) -> tuple[str, bytes]:
    """(identifier, bytes). A revisit carries the response's headers only."""
    name = record_name(page_id, digest)
    target = re.sub(r"[\r\n\0]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <{record_name(refers_to, digest)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Page-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    return name, "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers by lower-case name, HTTP head, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = BundleWriter()
    for batch in batches:
        for page_id, url, html, digest, size, response in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "response")), strict=True):
            payload = (html.as_py() or "").encode("utf-8")
            writer.add(*record(page_id.as_py(), url.as_py(), payload, digest.as_py(), size.as_py(), response.as_py()))
            if writer.total >= BUNDLE_BYTES:
                data, index = writer.finish()
                yield arrow(BUNDLE, data=[data], index=[index])
                writer = BundleWriter()
    if writer.index:
        data, index = writer.finish()
        yield arrow(BUNDLE, data=[data], index=[index])


def bundles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(data, index) for each bundle of the pages' records.

    pages has page_id, url and html; a null html is empty, a null url is named by the page's id; other columns are
    ignored. Of equal payloads of `least` bytes or more the largest page_id is the response, and rows that share it
    are all responses, with one identifier; if all their ids are null, all are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    best = base.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null").drop("n")
    rows = join_bounded(base, cut(best), ["digest"], "left", BROADCAST_PAYLOADS)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", "size", refers.alias("response")).transform(arrow_map(_bundles, BUNDLE_SQL))


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for data, index in zip(batch.column("data"), batch.column("index"), strict=True):
            data, rows, last, frame = data.as_py(), {f.name: [] for f in READ}, None, b""
            table = seek_table(data)
            for e in index.as_py():
                if e["frame"] != last:
                    start, packed, plain = table[e["frame"]]
                    frame, last = unpacker.decompress(data[start : start + packed], max_output_size=plain), e["frame"]
                headers, http, payload = parse(frame[e["offset"] : e["offset"] + e["length"]])
                kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if headers["warc-record-id"] != f"<{e['record_id']}>" or kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, said):
                    raise ValueError(f"record {e['record_id']} does not hold what it says")
                page, refers = headers.get("page-id"), headers.get("page-refers-to")
                for c, v in zip(rows, (None if page is None else int(page), size, said, kind, None if refers is None else int(refers)), strict=True):
                    rows[c].append(v)
            yield arrow(READ, **rows)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the bundles at path: page_id, payload_bytes, payload_digest, record_type, refers_to. Responses are checked against their digests."""
    return spark.read.parquet(path).transform(arrow_map(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))


def write_and_read(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Writes bundles to a new path in the shared folder and reads them back.

    A null html is an empty payload; payloads of any length are one record. Of rows that repeat a page_id, each has a record, and a row with a null
    page_id gives way to any other. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, name)
    bundles(pages).write.option("compression", "none").parquet(path)
    return read_bundles(spark, path)
