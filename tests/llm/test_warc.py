import base64
import gzip
import hashlib
import io
import zlib

import pytest

from plinth.llm import warc

PAGES = [
    (3, "http://a.example/x?y", "<p>same</p>"),
    (1, "http://b.example/", "<p>same</p>"),
    (2, None, None),
    (9, "no scheme\r\nInjected: x", ""),
    (4, "http://c.example/é", "<p>WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5</p>\r\n\r\n"),
    (5, "http://d.example/", "x" * 300_000),
    (6, "http://e.example/", "\r\n\r\n"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    first, out = {}, {}
    for i, _, html in sorted(rows):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = len(body) >= least and first.setdefault(digest, i)
        again = own is not False and own != i
        out[i] = (len(body), digest, "revisit" if again else "response", own if again else None)
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).selectExpr("*", "'x' as row", "'y' as first", "'z' as record_type")
    rows = warc.round_trip(pages, least).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == brute(PAGES, least)
    assert all(r.has_request and r.has_metadata for r in rows)


def test_archives_are_valid_and_nested_rows_hold_the_payload(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(PAGES, SCHEMA), path)
    files = [p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*"))]
    data = b"".join(map(gzip.decompress, files))
    members = []
    for rest in files:
        while rest:
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest) + one.flush())
            rest = one.unused_data
    assert len(members) == 3 * len(PAGES) and all(m.startswith(b"WARC/1.1") for m in members)
    found = list(warc.parse(io.BytesIO(data)))
    assert len(found) == 3 * len(PAGES)
    ids = {h["warc-record-id"] for h, _ in found}
    assert len(ids) == len(found) and all(h["warc-concurrent-to"] in ids for h, _ in found if h["warc-type"] in ("request", "metadata"))
    rows = {r.page_id: r for r in warc.transactions(warc.records(spark, path)).collect()}
    assert bytes(rows[4].content).decode() == PAGES[4][2]
    assert b"Host: a.example" in bytes(rows[3].request.content)


def test_damaged_archives_are_errors():
    good = warc.capture_records(1, "r", "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, "r")[1]
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(good[:-1])))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"junk\r\n")))


def test_empty_table_and_repeated_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = warc.round_trip(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a")], SCHEMA)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to or 0) for r in rows) == [("1", "response", 0), ("1", "revisit", 1), ("None", "revisit", 1)]


def test_a_hot_payload_and_one_of_many_megabytes(spark, tmp_path):
    rows = [(i, f"http://h/{i % 7}", "<p>hot</p>") for i in range(3000)] + [(5000, "http://l/", "long " * 5_000_000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 3001 and got[5000].payload_bytes == 25_000_000
    assert all(got[i].refers_to == 0 and got[i].record_type == "revisit" for i in range(1, 3000)) and got[0].record_type == "response"
    warc.write(pages, str(tmp_path / "small"), file_bytes=1 << 20)
    assert len(list((tmp_path / "small").glob("part-*"))) > 3
    assert warc.records(spark, str(tmp_path / "small"), with_content=False).count() == 3 * 3001
