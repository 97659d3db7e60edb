"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some records, followed by a skippable frame with the
seek table (the public seekable format: sizes of every frame, then a footer). The index maps a record's id to bundle,
frame and the offset within that frame, so one record is read by decompressing one frame. Bundles are rows of a table
(bundle_id, data), so they can be stored wherever Spark writes; write_bundles puts them into files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed values of the public seekable format.
_SKIPPABLE, _FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_URN = "urn:record:"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit holds the response's headers, whose Content-Length is the payload's, and no payload."""
    clean = re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{_URN}{'' if refers_to is None else refers_to}>", f"WARC-Profile: {_IDENTICAL}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at this offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
    start, size = end + 4, int(head["content-length"])
    block = data[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
    ident = lambda v: int(v.strip("<>").removeprefix(_URN)) if v and v.strip("<>") != _URN else None
    record = {"page_id": ident(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": head["warc-type"], "payload_bytes": full, "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "refers_to": ident(head.get("warc-refers-to")), "payload": payload if head["warc-type"] == "response" else None}
    return record, start + size + 4


class BundleWriter:
    """Collects records into frames and gives the finished bundle with its index."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames, self.sizes, self.open, self.held, self.size = [], [], [], 0, 0
        self.index: list[tuple[int | None, int, int, int]] = []  # record id, frame, offset in it, length

    def add(self, ident: int | None, record: bytes) -> None:
        self.index.append((ident, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.size += len(frame)
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self._close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = table + struct.pack("<IBI", len(self.sizes), 0, _FOOTER_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(footer)) + footer


class BundleReader:
    """Reads a bundle by its seek table, frame by frame."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != _FOOTER_MAGIC or flags:
            raise ValueError("no seek table without checksums at the end")
        table = data[len(data) - 9 - 8 * count : len(data) - 9]
        self.data, self.sizes, self.at, where = data, [], [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.at.append(where)
            self.sizes.append((packed, plain))
            where += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, n: int) -> bytes:
        packed, plain = self.sizes[n]
        return self.unpack.decompress(self.data[self.at[n] : self.at[n] + packed], max_output_size=plain)

    def record(self, frame: int, offset: int) -> dict:
        """The record at an index entry's place; only its frame is decompressed."""
        return parse_record(self.frame(frame), offset)[0]

    def records(self) -> Iterator[dict]:
        for n in range(len(self.sizes)):
            data, at = self.frame(n), 0
            while at < len(data):
                record, at = parse_record(data, at)
                yield record


_ENTRY = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLE = pa.schema([("bundle_id", pa.string()), ("data", pa.binary()), ("index", pa.list_(_ENTRY))])


def _write_rows(frame_bytes: int, bundle_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bundle(w: BundleWriter) -> pa.RecordBatch:
            data = w.finish()
            index = [dict(zip(("page_id", "frame", "offset", "length"), x, strict=True)) for x in w.index]
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([index], _BUNDLE.field("index").type)], schema=_BUNDLE)

        writer = None
        for batch in common.chunks(batches, "html"):
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                writer = writer or BundleWriter(frame_bytes)
                writer.add(r["page_id"], record_bytes(r["page_id"], r["url"], payload, payload_digest(payload), r["refers_to"], r["revisit"]))
                if writer.size + writer.held >= bundle_bytes:
                    yield bundle(writer)
                    writer = None
        if writer:
            yield bundle(writer)

    return rows


def write_archives(pages: DataFrame, min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Bundles (bundle_id, data, index) of one record for each row of pages (page_id, url, html; others are not read).

    Of rows with equal payloads of at least min_payload bytes, that with the smallest page_id becomes a response and
    the others revisits of it; a row repeated with that page_id is a response each time. Null html is an empty payload,
    a null url an empty one. A null page_id counts as larger than any; rows that all lack one are responses. An empty
    table gives no bundle. The digest alone decides who is first; payloads are shuffled once.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    judged = keyed.join(first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= min_payload)
    rows = judged.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"))
    return rows.mapInArrow(_write_rows(frame_bytes, bundle_bytes), "bundle_id string, data binary, index array<struct<page_id: long, frame: int, offset: long, length: long>>")


def read_archives(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of bundles (column data): page_id, url, record_type, payload_bytes, payload_digest, refers_to and,
    for responses, payload; its digest and length are checked against the record's. Fails on a damaged bundle."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    schema = pa.schema(fields if payloads else fields[:-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("data"):
                out, held = [], 0
                for r in BundleReader(cell.as_py()).records():
                    if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or payload_digest(r["payload"]) != r["payload_digest"]):
                        raise ValueError(f"record {r['page_id']} does not match its digest")
                    held += len(r["payload"] or b"")
                    out.append(r)
                    if held > common.CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    types = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return bundles.select("data").mapInArrow(rows, types + ", payload binary" * payloads)


def read_records(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some page_ids, through the index: only the frames that hold them are decompressed."""
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    places = bundles.select("bundle_id", F.explode("index").alias("e")).select("bundle_id", "e.page_id", "e.frame", "e.offset")
    wanted = places.join(page_ids.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id", "left_semi").groupBy("bundle_id").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("data"), batch.column("places").to_pylist(), strict=True):
                reader = BundleReader(data.as_py())
                yield pa.RecordBatch.from_pylist([{k: v for k, v in reader.record(p["frame"], p["offset"]).items() if k in dict(fields)} for p in places], pa.schema(fields))

    return bundles.join(wanted, "bundle_id").select("data", "places").mapInArrow(rows, "page_id long, record_type string, payload_digest string, refers_to long, payload binary")


def write_bundles(bundles: DataFrame, folder: str) -> None:
    """Put each bundle into a file <bundle_id>.warc.zst below folder, a path or URI that all executors can write to."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        for batch in batches:
            for name, data in zip(batch.column("bundle_id").to_pylist(), batch.column("data"), strict=True):
                with store.open_output_stream(f"{base}/{name}.warc.zst", compression=None) as out:  # a repeated task writes the same bytes
                    out.write(data.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("bundle_id")], ["bundle_id"])

    bundles.select("bundle_id", "data").mapInArrow(put, "bundle_id string").write.format("noop").mode("overwrite").save()


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = common.stage(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "bundles", "none")
    return read_archives(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i * 5 + 1, 5))::INTEGER) AS v FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
