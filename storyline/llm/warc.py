"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames. A bundle is a run of frames and ends in a skippable frame with a seek table
(for each frame: compressed and raw size), as the public seekable format lays it down, so any Zstandard tool still decodes the whole.
The bundle table holds one row per bundle: its bytes, and for each record its identifier, its frame and its offset and length within the
raw frame. A record is read by decompressing its one frame.

Bundles are rows of a binary column in a written table, so that they live in whatever store Spark writes to; export_files() writes them
as plain .warc.zst files where a folder is mounted everywhere. A bundle is a cell of at most about 2 MB: locate() gives a record's offset in
its frame, and reading it fetches the cell that has the frame, not the frame alone; seeking within a bundle is for the exported files.

Defined cases: records of rows with one page_id have one WARC-Record-ID, as they are told apart by nothing else. A
null payload is empty. A null page identifier is written as "null", is never a response that others refer to and comes
back as null. Repeated rows each give a record. An empty table gives no bundle. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed values of the seekable format: the skippable frame's magic number, and the seek table's own at its end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads below this length are stored again each time.
LEAST_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 2 << 20
BUNDLES = "bundle string, data binary, record_ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"
RECORDS = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The block of a revisit has the HTTP header alone, whose Content-Length is the whole payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', uri or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def number(text: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
    return int(found[1]) if found else None


class BundleWriter:
    """Groups records into frames and closes a bundle with its seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.start()

    def start(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.raw, self.raw_bytes, self.size = [], 0, 0
        self.ids: list[str] = []
        self.where: list[tuple[int, int, int]] = []

    def add(self, record_id: str, data: bytes) -> None:
        self.ids.append(record_id)
        self.where.append((len(self.frames), self.raw_bytes, len(data)))
        self.raw.append(data)
        self.raw_bytes += len(data)
        if self.raw_bytes >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.raw:
            packed = self.zstd.compress(b"".join(self.raw))
            self.frames.append((packed, self.raw_bytes))
            self.size += len(packed)
            self.raw, self.raw_bytes = [], 0

    def finish(self) -> tuple[bytes, list[str], list[int], list[int], list[int]]:
        self.end_frame()
        table = b"".join(struct.pack("<II", len(data), raw) for data, raw in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        data = b"".join(data for data, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table
        out = (data, self.ids, *(list(x) for x in zip(*self.where, strict=True)))
        self.start()
        return out


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame, from the bundle's footer alone."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    at, start, out = len(bundle) - 9 - count * entry, 0, []
    if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE, count * entry + 9):
        raise ValueError("the seek table is damaged")
    for i in range(count):
        size, raw = struct.unpack("<II", bundle[at + i * entry : at + i * entry + 8])
        out.append((start, size, raw))
        start += size
    return out


def frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    start, size, raw = entry
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=raw)


def parse(data: bytes) -> dict:
    """A record's fields. The payload of a response is checked against the digest it carries."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't have the payload that it names")
    return {"page_id": number(fields["WARC-Record-ID"]), "uri": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": length, "payload_digest": digest, "payload": None if revisit else payload}


def with_references(pages: DataFrame, ws: Workspace) -> DataFrame:
    """page_id, url, payload, digest, refers_to. Only payloads that occur under more than one identifier are joined; their first pages
    are written first, so both sides of the join are plain exchanges and Spark may split a payload that very many pages share."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= LEAST_REVISIT
    firsts = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    firsts = ws.put(firsts.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "firsts")
    joined = rows.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def bundles(rows: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """One row per bundle of rows (page_id, url, payload, digest, refers_to)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(frame_bytes)
        schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])

        def closed() -> pa.RecordBatch:
            data, *index = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary()), *(pa.array([x], t.type) for x, t in zip(index, list(schema)[2:], strict=True))], schema=schema)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, refers = page_id.as_py(), refers_to.as_py()
                writer.add(urn(page), record(page, url.as_py(), payload.as_py(), digest.as_py(), refers))
                if writer.size >= bundle_bytes:
                    yield closed()
        if writer.ids:
            yield closed()

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, BUNDLES)


def write_bundles(pages: DataFrame, ws: Workspace, name: str = "bundles", **sizes: int) -> DataFrame:
    """Writes the archives of pages and returns the table of bundles. Already compressed, they're stored as they are."""
    return ws.put(bundles(with_references(pages, ws), **sizes), name, codec="none", **{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4, "parquet.block.size": 16 << 20})


def read_records(table: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of a table of bundles, found through each bundle's seek table and index."""
    columns = [c for c in RECORDS.split(", ") if payloads or c != "payload binary"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in columns]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns])
        for batch in batches:
            for data, frames, offsets, lengths in zip(*(batch.column(i) for i in range(4)), strict=True):
                bundle, table, last, raw = data.as_py(), None, -1, b""
                table, out = seek_table(bundle), []
                for k, offset, length in zip(frames.as_py(), offsets.as_py(), lengths.as_py(), strict=True):
                    if k != last:
                        if out and payloads:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                        last, raw = k, frame(bundle, table[k])
                    found = parse(raw[offset : offset + length])
                    out.append({n: found[n] for n in names})
                yield pa.RecordBatch.from_pylist(out, schema)

    return table.select("data", "frames", "offsets", "lengths").mapInArrow(read, ", ".join(columns))


def locate(table: DataFrame, page_ids: list[int]) -> DataFrame:
    """Bundle, frame, offset and length of records; reads the index columns only."""
    at = F.explode(F.arrays_zip("record_ids", "frames", "offsets", "lengths")).alias("at")
    return table.select("bundle", at).where(F.col("at.record_ids").isin([urn(p) for p in page_ids])).select("bundle", F.col("at.record_ids").alias("record_id"), F.col("at.frames").alias("frame"), F.col("at.offsets").alias("offset"), F.col("at.lengths").alias("length"))


def export_files(table: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as folder/<bundle>.warc.zst; the folder must be mounted on every executor. Returns the paths."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = Path(folder, f"{name}.warc.zst")
                to.with_suffix(".tmp").write_bytes(data)
                to.with_suffix(".tmp").rename(to)
                yield pa.RecordBatch.from_pydict({"path": [str(to)]})

    return table.select("bundle", "data").mapInArrow(write, "path string")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives all pages, then reads the archives back."""
    table = write_bundles(pages, Workspace(spark, "warc"))
    return read_records(table, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h),
r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND (page_id IS NULL OR page_id <> first_id) AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM r
"""
