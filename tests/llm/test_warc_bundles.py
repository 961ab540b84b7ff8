import base64
import hashlib
import io
import random

import duckdb
import pytest
import zstandard

from lodestrand.llm import warc_bundles as wb
from lodestrand.llm.common import fresh_path

from ..conftest import SMALL

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows, least=0):
    largest = {}
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        own = len(data) < least or i == largest.get(html or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else largest[html or ""]))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://b/ü x\r\nWARC-Type: no", "two\r\n\r\nWARC/1.1\r\n"), (4, "", None), (5, "u", ""), (6, "v", "é" * 70000), (None, "w", "<p>one</p>"), (None, "x", "alone"), (7, "y", "same row"), (7, "y", "same row"), (-2, "z", "\x00\x85 ")]


def test_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, refers_to int").repartition(3)
    got = wb.round_trip(df, frame_bytes=100, bundle_bytes=200)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(ROWS)
    got = wb.round_trip(df, least=11)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(ROWS, 11)
    assert wb.round_trip(df.limit(0)).count() == 0


def test_files_are_seekable_archives(spark, tmp_path):
    """Any decoder reads a file whole; a frame alone holds whole records."""
    path = str(tmp_path / "bundles")
    rnd = random.Random(1)
    rows = [(k, f"http://x/{k}", "".join(rnd.choices("abc <p>\r\n", k=rnd.randrange(400)))) for k in range(300)]
    wb.write_bundles(wb.marked(spark.createDataFrame(rows, "page_id long, url string, html string")), path, frame_bytes=4000, bundle_bytes=5000)
    files = sorted(tmp_path.glob("bundles/part-*"))
    assert len(files) > 3
    records = 0
    for f in files:
        data = f.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        b = wb.Bundle(data)
        frames = [b.text(k) for k in range(len(b.ends) - 1)]
        assert b"".join(frames) == whole and [len(x) for x in frames] == b.raw[:-1].tolist() and frames
        assert data[-4:] == wb.SEEK_END and int.from_bytes(data[-9:-5], "little") == len(frames) + 1
        # records lie one after the other, and each is where the directory says
        seen = b""
        for k, record in b.records():
            assert bytes(record).startswith(b"WARC/1.1\r\n") and b"<" + b.ids[k] + b">" in bytes(record)
            seen += bytes(record)
            records += 1
        assert seen == whole
    assert records == 300


def test_index_and_fetch(spark, tmp_path):
    path = str(tmp_path / "bundles")
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    wb.write_bundles(wb.marked(df), path, frame_bytes=60)
    index = wb.record_index(spark, path)
    assert index.count() == len(ROWS)
    ids = index.where("record_id like 'urn:page:3:%' or record_id like 'urn:page:9:%'").select("record_id")
    got = {r.record_id.split(":")[2]: bytes(r.record) for r in wb.fetch(spark, index, ids).collect()}
    assert set(got) == {"3", "9"}
    warc, http, payload = wb.parsed(memoryview(got["3"]))
    assert bytes(payload) == b"two\r\n\r\nWARC/1.1\r\n" and warc[b"warc-target-uri"] == b"http://b/%C3%BC%20x%0D%0AWARC-Type:%20no" and warc[b"warc-type"] == b"response"
    assert wb.fetch(spark, index, spark.createDataFrame([("urn:page:77:X",)], "record_id string")).count() == 0
    full = {r.page_id: r for r in wb.read_bundles(spark, path, keep_payload=True).where("record_type = 'response'").collect()}
    assert bytes(full[6].payload) == ("é" * 70000).encode() and full[9].url is None


def test_broken_files(spark, tmp_path):
    w = wb.BundleWriter()
    digest = base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    w.add(wb.record_id(1, digest)[1:-1].encode(), wb.warc_record(1, None, b"payload", digest, None, True, "1970-01-01T00:00:00Z"))
    (tmp_path / "part-1").write_bytes(w.finish())
    with pytest.raises(Exception, match="not what its record says"):
        wb.read_bundles(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="seek table"):
        wb.Bundle(b"something else")


def test_hot_payload(spark):
    """A payload that a third of all pages have, and a task with nothing to write."""
    df = spark.range(3000).selectExpr("id as page_id", "null as url", "if(id % 3 = 0, 'same', cast(id as string)) as html").repartition(7)
    got = wb.round_trip(df)
    assert got.count() == 3000 and got.where("record_type = 'revisit' and refers_to = 2997").count() == 999


def test_bundles_are_deleted(spark):
    from lodestrand.places import shared_dir
    from pathlib import Path

    wb.round_trip(spark.createDataFrame(ROWS, "page_id long, url string, html string")).count()
    assert not list(Path(shared_dir(spark)).glob("lodestrand/bundles-*")) and fresh_path(spark, "bundles")


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    want = con.execute(wb.OP11_SQL).fetchall()
    got = wb.op11_warc_bundles(spark, SMALL).select(*COLUMNS).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
