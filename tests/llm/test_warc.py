import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from tidewell.llm import warc
from tidewell.session import work_dir

COLUMNS = "page_id long, url string, html string, type string, archive string, value string"
LONG = "<p>" + "long\r\n\r\nWARC/1.1\r\n" * 20


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], COLUMNS).repartition(3)


ROWS = [
    (5, "http://a.example/", LONG), (3, "http://b.example/ü", LONG), (9, None, LONG), (3, "http://again/", LONG), (1, "http://c/\r\nX: y", "short"),
    (2, "http://d/", "short"), (4, "", None), (6, "http://e/", ""), (7, "http://f/", "\n"), (8, "http://g/", "ends in a break\n"),
    (10, "http://h/", "€😀\x00" * 40), (11, "http://i/", "€😀\x00" * 40), (12, "http://j/", "x" * 99), (13, "http://k/", "x" * 99),
    (14, "http://l/", "x" * 100), (15, "http://m/", "x" * 100), (None, "http://n/", LONG), (None, None, None), (16, "http://o/", "y" * 300_000),
]


def plainly(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = i is not None and len(data) >= 100 and i > first[html]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("lookup_bytes", [1 << 20, 0])
def test_pages_come_back(spark, lookup_bytes):
    got = warc.report(frame(spark, ROWS), archive_bytes=500, lookup_bytes=lookup_bytes)
    assert got.select("archive").distinct().count() > 3
    got = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plainly(ROWS)


def test_empty_table(spark):
    got = warc.report(frame(spark, []))
    assert got.collect() == [] and got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_text_keys(spark):
    pages = frame(spark, ROWS[:4]).withColumn("page_id", F.concat(F.lit("k <>/"), F.col("page_id").cast("string")))
    rows = warc.report(pages).collect()
    assert sorted((r.page_id, r.refers_to) for r in rows) == [
        ("k <>/3", None), ("k <>/3", None), ("k <>/5", "k <>/3"), ("k <>/9", "k <>/3")]


def test_every_member_is_a_record_at_its_place(spark):
    folder = work_dir(spark, "warc")
    warc.report(frame(spark, ROWS), folder=folder, archive_bytes=2_000)
    files = {}
    for path, content in spark.read.format("binaryFile").load(f"{folder}/records/kind=archive").select("path", "content").collect():
        whole = gzip.GzipFile(fileobj=io.BytesIO(content)).read()  # an ordinary reader takes every file
        name = whole.split(b"WARC-Filename: ")[1].split(b"\r")[0].decode()
        files[name] = bytes(content)
    index = warc.read_index(spark, f"{folder}/records").collect()
    assert len(index) == len(ROWS)
    for r in index:
        data = zlib.decompress(files[r.archive][r.offset:r.offset + r.length], 31)
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: " + r.type.encode()) and f"WARC-Record-ID: {r.record}".encode() in data
        assert data.endswith(b"\r\n\r\n")
    asked = spark.createDataFrame([("<urn:page:16>",), ("<urn:page:10>",), ("<urn:page:10>",), ("<urn:page:77>",)], "record string")
    got = {r.record: r.payload for r in warc.fetch(spark, f"{folder}/records", asked).collect()}
    assert got == {"<urn:page:16>": b"y" * 300_000, "<urn:page:10>": "€😀\x00".encode() * 40}


def lines(data):
    return [(line, 1) for line in data.split(b"\n")]


def record(body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_records_are_cut_at_their_length():
    bodies = [b"", b"\n", b"\r\n\r\n", b"WARC/1.0\r\n\r\n", bytes(range(256)), b"a\nb"]
    got = list(warc.cut_records(iter(lines(b"".join(map(record, bodies))))))
    assert [b.partition(b"\r\n\r\n")[2][:-4] for _, b in got] == bodies
    folded = record(b"x", b"X-Long: one\r\n  two\r\n")
    assert next(warc.cut_records(iter(lines(folded))))[0]["x-long"] == "one two"


def test_damaged_files_raise():
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.cut_records(iter(lines(record(b"abcdef")[:-9]))))
    with pytest.raises(ValueError, match="no record"):
        list(warc.cut_records(iter(lines(b"garbage\r\n" + record(b"a")))))
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.members(gzip.compress(b"abc" * 100)[:-9]))
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n")


def test_a_single_stream_of_another_writer(spark, tmp_path):
    data = b"".join(record(b"body %d\n" % i * (i + 1), b"WARC-Record-ID: <urn:x:%d>\r\n" % i) for i in range(50))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "in" / "two.warc.gz").write_bytes(gzip.compress(data[:len(data) // 2].rsplit(b"WARC/1.0", 1)[0]))
    warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out"), archive_bytes=1_000)
    found = warc.read_archives(spark, str(tmp_path / "out"))
    assert found.where("archive is null").count() == 0
    assert found.join(warc.read_index(spark, str(tmp_path / "out")), ["archive", "offset", "length", "record"]).count() == found.count() > 70
