"""Writing and reading WARC archives: one gzip member a record, read in byte ranges.

``write`` puts a record for every page into archives below a folder, a file for each task. Where payloads are equal, one
page keeps the payload as a response record and the others become revisit records that name it. ``read`` cuts every
archive into byte ranges. A task looks for the gzip magic from the start of its range on, and takes a place for a record
only if the member there decodes to the end with the right checksum, starts as a WARC record with the headers a record
needs, and is followed by another member or the end of the file. It owns the records that start in its range, and reads
past the end of the range to finish the last one.

Archives go through Arrow's file systems (local or mounted folders, HDFS, S3, GCS), so the folder must be a path or
address one of them knows. A task writes to a file name of its own and reports it; only reported files count, hence a
task that is run again does no harm. Pages themselves are read by Spark from wherever it can.

Defined results: a null payload is empty. Equal payloads of at least ``least`` bytes share one response, the page with
the largest id; rows that repeat this id and payload are responses too. A null id loses against any other; where all are
null, all are responses. Payloads are read and written whole, a record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletop.llm.common import batches, stored

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 * 1024 * 1024
MOST_TASKS = 100_000
_CHUNK = 256 * 1024
_STEP = 8 * 1024
# Fixed values of the format.
_RESPONSE_TYPE = "application/http;msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def digest(payload: bytes) -> str:
    """SHA-1 in base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member with a response record, or a revisit record that has the headers of the payload but not itself."""
    name = lambda number: f"<urn:page:{'' if number is None else number}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": "".join(c for c in url or "" if c not in "\r\n"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": _RESPONSE_TYPE,
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        headers |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": _PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{key}: {value}\r\n" for key, value in headers.items()) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers with small names and the block of a decoded record, or None if it is no such record."""
    if not raw.startswith(b"WARC/"):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        headers[key.strip().lower()] = value.strip()
    if any(name not in headers for name in _NEEDED) or not headers["content-length"].isdigit():
        return None
    block = raw[end + 4:end + 4 + int(headers["content-length"])]
    return (headers, block) if len(block) == int(headers["content-length"]) else None


class _Window:
    """Bytes of a file from a moving place on; reads ahead in chunks."""

    def __init__(self, file, place: int):
        self.file, self.place, self.held, self.at = file, place, b"", 0
        file.seek(place)

    def more(self) -> bool:
        chunk = self.file.read(_CHUNK)
        self.held, self.at = self.held[self.at:] + chunk, 0
        return bool(chunk)

    def left(self) -> int:
        return len(self.held) - self.at

    def move(self, count: int) -> None:
        self.at += count
        self.place += count


def _member(window: _Window) -> tuple[bytes, int] | None:
    """Content and length of the gzip member at the window's place, or None if there is no sound one."""
    unpacker, parts, fed, checked = zlib.decompressobj(31), [], 0, False
    try:
        while not unpacker.eof:
            if fed == window.left() and not window.more():
                return None
            some = window.held[window.at + fed:window.at + fed + _STEP]
            parts.append(unpacker.decompress(some))
            fed += len(some)
            if not checked and len(head := b"".join(parts)) >= 5:
                if not head.startswith(b"WARC/"):
                    return None
                checked = True
    except zlib.error:
        return None
    length = fed - len(unpacker.unused_data)
    while window.left() < length + len(MAGIC) and window.more():
        pass
    follows = window.held[window.at + length:window.at + length + len(MAGIC)]
    return (b"".join(parts), length) if not follows or follows == MAGIC else None


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of every record that starts in ``[start, end)``."""
    window = _Window(file, start)
    while True:
        found = window.held.find(MAGIC, window.at)
        if found < 0:
            window.move(max(0, window.left() - len(MAGIC) + 1))
            if window.place >= end or not window.more():
                return
            continue
        window.move(found - window.at)
        if window.place >= end:
            return
        member = _member(window)
        whole = member and parse(member[0])
        if whole:
            yield window.place, *whole
        window.move(member[1] if whole else 1)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Of pages whose payload another one holds: ``page_id``, ``refers_to`` and the payload's ``sha1``."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = stored(pages.select("page_id", F.sha1(raw).alias("sha1"), F.length(raw).alias("bytes")), "warc")
    known = known.where(F.col("bytes") >= least)
    first = known.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.drop("n"), "warc")
    later = known.join(first, "sha1").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return later.select("page_id", "refers_to", "sha1").distinct()


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives below ``folder`` for ``pages`` (``page_id``, ``url``, ``html``); returns ``path``, ``bytes``, ``records``."""
    pages = pages.select("page_id", "url", "html")
    later = revisits(pages, least).select(F.col("page_id").alias("id"), "refers_to", F.col("sha1").alias("same"))
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # By id: pages spread evenly however many share a payload.
    joined = pages.join(later, pages.page_id.eqNullSafe(later.id) & (F.sha1(raw) == F.col("same")), "left")

    def put(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        size = count = 0
        with system.open_output_stream(path, compression=None) as file:
            for frame in batches(frames, "html"):
                columns = (frame.column(name).to_pylist() for name in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns):
                    member = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, date)
                    file.write(member)
                    size, count = size + len(member), count + 1
        yield pa.RecordBatch.from_pylist(
            [{"path": path, "bytes": size, "records": count}],
            pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    wanted = joined.select("page_id", "url", "html", "refers_to")
    return stored(wanted.mapInArrow(put, "path string, bytes bigint, records bigint"), "warc")


def read(spark: SparkSession, folder: str, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of ``archives`` (``path``, ``bytes``): ``path``, ``place``, ``headers``, ``block``.

    ``folder`` names the file system; the paths are those that ``write`` returns. There are as many tasks as ranges, up to
    ``MOST_TASKS``; beyond that a task reads several ranges, one after another.
    """
    step = F.lit(range_bytes).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), step)
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    # A stated number of partitions: adaptive execution would merge these short rows into one task, whatever they stand for.
    count = F.ceil(F.col("bytes") / F.lit(range_bytes))
    tasks = archives.where("bytes > 0").agg(F.sum(count)).first()[0] or 1
    ranges = ranges.repartition(min(int(tasks), MOST_TASKS), "path", "start")

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("path", pa.string()), ("place", pa.int64()),
                            ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
        for frame in frames:
            for row in frame.to_pylist():
                held, size = [], 0
                with system.open_input_file(row["path"]) as file:
                    for place, headers, block in records_in(file, row["start"], min(row["start"] + range_bytes, row["bytes"])):
                        held.append({"path": row["path"], "place": place, "headers": list(headers.items()), "block": block})
                        size += len(block)
                        if size > 4_000_000 or len(held) >= 2000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.mapInArrow(scan, "path string, place bigint, headers map<string,string>, block binary")
