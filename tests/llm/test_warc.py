import base64
import hashlib
import io

import pytest
import zstandard

from lotwright.llm import warc


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_driver_table(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted((tuple(r) for r in warc.op2_warc_bundles(spark, sf).collect()), key=str)
    assert got == brute(rows)


ODD = [(5, "<p>x</p>"), (2, "<p>x</p>"), (9, None), (8, ""), (None, ""), (None, "solo"), (3, "y\r\n\r\nWARC/1.1"), (3, "y\r\n\r\nWARC/1.1"), (4, "ü" * 700_000), (1, "\r\n\r\n")]


@pytest.mark.parametrize("rows", [[], ODD])
def test_round_trip_of_odd_rows(spark, rows):
    df = spark.createDataFrame([(i, None if i == 5 else "http://a/\r\nb", h, "z") for i, h in rows], "page_id long, url string, html string, digest string")
    bundles = warc.write_archives(df, frame_bytes=50).cache()
    got = warc.read_archives(bundles).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    by_id = {i: (h or "").encode() for i, h in rows}
    assert all(r.payload == by_id[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    if rows:
        found = warc.read_records(bundles, spark.createDataFrame([(4,), (5,), (77,)], "page_id long")).collect()
        assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {(4, "response", None), (5, "revisit", 2)}


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(df, min_payload=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_bundle_is_plain_zstandard_too(tmp_path, spark):
    w = warc.BundleWriter(frame_bytes=10)
    records = [warc.record_bytes(i, "u", b"x" * i, warc.payload_digest(b"x" * i), None, False) for i in range(5)]
    for i, r in enumerate(records):
        w.add(i, r)
    data = w.finish()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    reader = warc.BundleReader(data)
    for i, frame, offset, _ in w.index:
        assert reader.record(frame, offset)["page_id"] == i
    df = spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string")
    warc.write_bundles(warc.write_archives(df), f"file://{tmp_path}/out")
    (path,) = (tmp_path / "out").iterdir()
    assert next(warc.BundleReader(path.read_bytes()).records())["payload"] == b"ab"
