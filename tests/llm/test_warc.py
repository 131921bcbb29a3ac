import hashlib
import sys
from pathlib import Path

import zstandard
from sievework.llm import queries, warc_bundles as wb

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import agree


def test_sql(spark, sf_dir_2):
    rows = agree(queries.op8_warc_bundles(spark, sf_dir_2), queries.OP8_SQL, sf_dir_2)
    assert rows


def test_odd_rows(spark):
    big = "é" * 600
    rows = [(1, "u", big, "x"), (5, "u\r\nEvil: 1", big, "x"), (5, None, big, "x"), (None, "u", big, "x"), (2, "u", "small", "x"), (3, "u", "small", "x"), (4, None, None, "x"), (6, "u", "", "x"), (7, "u", "WARC/1.1\r\n\r\n" * 1000, "x"), (8, "u", "long " * 400000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, response string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in wb.write_and_read(df).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted((p or 0, len((h or "").encode()), sha(h), "revisit" if h == big and p != 5 else "response", 5 if h == big and p != 5 else None) for p, _, h, _ in rows)
    assert got == want
    assert wb.write_and_read(df.limit(0)).count() == 0


def test_one_record_is_read_from_one_frame():
    w = wb.BundleWriter(frame_bytes=500)
    records = [wb.record(i, f"http://x/{i}", f"page {i} ".encode() * i, "d", 7 * i) for i in range(40)]
    for r in records:
        w.add(*r)
    data, index = w.finish()
    assert len(wb.seek_table(data)) > 5
    for name, r in records:
        assert wb.read_record(data, index, name) == r
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole == b"".join(r for _, r in records)
    broken = bytearray(data)
    for start, packed, _ in wb.seek_table(data)[1:]:
        broken[start : start + packed] = bytes(packed)
    assert wb.read_record(bytes(broken), index, records[0][0]) == records[0][1]


def test_revisits_carry_no_payload():
    name, r = wb.record(1, "u", b"", "d", 9, refers_to=4)
    headers, http, payload = wb.parse(r)
    assert payload == b""
    assert headers["warc-refers-to"] == f"<{wb.record_name(4, 'd')}>"
    assert b"Content-Length: 9" in http
