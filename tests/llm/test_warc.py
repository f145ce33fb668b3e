import base64
import gzip
import hashlib
import io
import zlib

import odd  # noqa: F401 - its folder is on the path
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tabletop.llm import warc as W
from tabletop.llm.queries import op6_warc
from tabletop.session import working_folder


def expected(pages):
    """Page id, bytes, digest, type and reference of every page, in plain code."""
    largest = {}
    for page_id, _, html in pages:
        raw = (html or "").encode()
        largest[raw] = max(largest.get(raw, -1), -1 if page_id is None else page_id)
    for page_id, _, html in pages:
        raw = (html or "").encode()
        first = largest[raw] in (page_id, -1)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        yield page_id, len(raw), digest, "response" if first else "revisit", None if first else largest[raw]


def test_query(spark, small):
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, op6_warc(spark, small).collect())) == sorted(expected(pages))


def test_odd_pages(spark, tmp_path):
    long = "".join(chr(32 + i * i % 90) for i in range(700_000))
    pages = [(1, "http://a", "x"), (2, None, "x"), (2, None, "x"), (3, "u\r\nEvil: 1", None), (4, "", ""), (5, "é", "\x1f\u008b\x08"),
             (None, "n", "x"), (6, "l", long), (7, "m", long), (None, "o", "alone")]
    table = spark.createDataFrame([(*p, "c", "d") for p in pages], "page_id bigint, url string, html string, refers_to string, sha1 string")
    table.write.parquet(f"{tmp_path}/pages.parquet")
    rows = op6_warc(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected(pages)))
    table.limit(0).write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert op6_warc(spark, f"{tmp_path}/empty").count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")], "page_id bigint, url string, html string")
    assert [tuple(r)[:2] for r in W.revisits(pages, least=3).collect()] == [(3, 4)]


@pytest.mark.parametrize("step", [1, 7, 100, 1000, 100_000])
def test_every_cut_gives_every_record_once(step):
    members = [W.record(i, f"u{i}", bytes(range(256)) * (i % 5), i - 1 if i % 3 == 2 else None, "d") for i in range(12)]
    whole = b"".join(members)
    places = [len(b"".join(members[:i])) for i in range(len(members))]
    found = [r for s in range(0, len(whole), step) for r in W.records_in(io.BytesIO(whole), s, min(s + step, len(whole)))]
    assert [place for place, _, _ in found] == places
    assert [headers["warc-record-id"] for _, headers, _ in found] == [f"<urn:page:{i}>" for i in range(12)]


def test_magic_inside_a_member_and_damage():
    inner = W.record(99, "inner", b"payload", None, "d")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the inner member stands there byte for byte
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n"
    block = inner + b"tail"
    outer = packer.compress(text % len(block) + block + b"\r\n\r\n") + packer.flush()
    last = W.record(2, "", b"z", None, "d")
    whole = outer + last
    for start in (0, 20, len(outer) - 3):
        ids = [h["warc-record-id"] for _, h, _ in W.records_in(io.BytesIO(whole), start, len(whole))]
        assert ids == ["<urn:page:1>", "<urn:page:2>"][start > 0:]
    broken = last[:-6] + b"\0" * 6
    assert [h["warc-record-id"] for _, h, _ in W.records_in(io.BytesIO(broken + last), 0, 10**6)] == ["<urn:page:2>"]
    assert list(W.records_in(io.BytesIO(gzip.compress(b"no record")), 0, 10**6)) == []


def test_small_ranges_on_spark(spark, small):
    folder = working_folder(spark, "archives")
    pages = spark.read.parquet(f"{small}/pages.parquet")
    archives = W.write(pages, folder)
    assert archives.agg({"records": "sum"}).first()[0] == pages.count()
    records = W.read(spark, folder, archives, range_bytes=3000)
    places = records.select("path", "place").collect()
    assert len(places) == len(set(places)) == pages.count()
    ranges = sum(-(-row["bytes"] // 3000) for row in archives.collect())
    tasks = records.groupBy(F.spark_partition_id()).count().count()
    assert ranges > 8 and tasks > ranges / 3
    system, base = fs.FileSystem.from_uri(folder)
    files = system.get_file_info(fs.FileSelector(base))
    assert sum(file.size for file in files) == archives.agg({"bytes": "sum"}).first()[0]
