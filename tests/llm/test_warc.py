import gzip
import hashlib
import io
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from tidegate.llm import warc as W

PAGES = "page_id bigint, url string, html string, d string, revisit string, owner string"
ROWS = [
    (1, "http://a/1", "same", "x", "x", "x"), (2, "http://a/2", "same", "x", "x", "x"), (3, "http://a/3", "other é", "x", "x", "x"),
    (4, None, None, None, None, None), (5, "http://a/5\r\nX: y", "", "x", "x", "x"), (None, "u", "same", "x", "x", "x"),
    (6, "u", "long " * 200_000, "x", "x", "x"), (7, "u", "twice", "x", "x", "x"), (7, "u", "twice", "x", "x", "x"),
    (None, "v", "alone", "x", "x", "x"), (None, "w", "alone", "x", "x", "x"),
]


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        size = len((html or "").encode())
        ids = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        owner = max(ids) if ids else None
        copies = sum((h or "") == (html or "") for _, _, h, *_ in rows)
        revisit = size >= least and copies > 1 and page != owner
        out.append((page, size, digest(html), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES)
    rows = W.round_trip(pages, least).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == expected(ROWS, least)
    assert W.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_and_archive_sizes(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(2)
    archives = W.write_archives(pages, str(tmp_path), archive_bytes=500)
    listed = archives.collect()
    assert sum(r.records for r in listed) == len(ROWS) and len(listed) > 2
    rows = W.read_archives(archives, str(tmp_path), with_payload=True).collect()
    bodies = {p: (h or "").encode() for p, _, h, *_ in ROWS if p is not None}
    assert all(bytes(r.payload) == bodies[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    assert all(r.payload is None for r in rows if r.record_type == "revisit")
    # every member is plain gzip, as other readers expect
    with open(listed[0].path, "rb") as file:
        assert gzip.decompress(file.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def records(data, **options):
    return list(W.read_records(io.BytesIO(data), **options))


def test_reader_takes_small_pieces(monkeypatch):
    data = b"".join(W.encode_record(i, "u", b"p%d" % i * 50, "2024-01-01T00:00:00Z", None, False) for i in range(5))
    want = [(r.offset, r.payload, r.payload_digest) for r in records(data, with_payload=True)]
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(W, "_PIECE", piece)
        assert [(r.offset, r.payload, r.payload_digest) for r in records(data, with_payload=True)] == want
    offsets = [o for o, *_ in want]
    assert [gzip.decompress(data[a:b]).count(b"WARC/1.1") for a, b in zip(offsets, offsets[1:] + [len(data)])] == [1] * 5


def test_damage_is_found():
    good = W.encode_record(1, "u", b"payload" * 20, "2024-01-01T00:00:00Z", None, False)
    plain = gzip.decompress(good)
    for bad in (
        plain.replace(b"payload", b"paYload", 1), plain[:-1], plain + b"x",
        plain.replace(b"WARC/1.1", b"XXXX/1.1"),
        plain.replace(digest("payload" * 20).encode(), b"A" * 32),
    ):
        with pytest.raises(ValueError):
            records(gzip.compress(bad))
    with pytest.raises(ValueError):
        records(good[:-9])
    assert records(b"") == []


def test_very_long_url_and_many_empty_pages(spark):
    rows = [(k, "data:" + "x" * 2_100_000 if k == 3 else f"http://a/{k}", "" if k % 3 == 0 else f"page {k}", "x", "x", "x")
            for k in range(60)]
    pages = spark.createDataFrame(rows, PAGES)
    got = W.round_trip(pages).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(rows)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"text {k} " * 50, "x", "x", "x") for k in range(80)], PAGES)
    archives = W.write_archives(pages, str(tmp_path), archive_bytes=2_000)
    read = W.read_archives(archives, str(tmp_path)).withColumn("task", F.spark_partition_id())
    assert archives.count() > 4 and read.select("task").distinct().count() > 4
