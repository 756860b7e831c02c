"""WARC archives: writing, normalising to a gzip member for each record, reading by offset.

``write`` makes archives that are one gzip stream each. ``normalise`` inflates
such a file (or any mix of members) once, front to back, writes every record as
a member of its own and puts a sidecar index beside it: offset and length of
each member, record type and id. ``read`` fetches members by that index.

Equal payloads are stored once: the record with the largest page_id is a
response, the others revisit it. Only payloads that occur more than once go
into the join that settles this, so pages move over the network only where
that table is too large to broadcast, and then by the skew-aware join.

Defined results: a null html is an empty payload, and empty payloads are equal
to one another; a row without page_id is never referred to, and among equal
payloads none of which has a page_id all are responses; rows that repeat the
largest page_id are all responses; control characters of a url come back
percent-encoded, a null url stays null; an empty table gives no archive and no
row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import chunks, in_arrow, open_file, put_file, scratch, staged, table, utf8

#: Bytes of payload after which the next archive of a task begins.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 20
ID = "urn:docspark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
#: A bound for headers, so that a broken file cannot be gathered whole in search of their end.
MOST_HEADER = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'-' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The plain bytes of all gzip members of a stream, in one pass."""
    raw, plain = read(READ_BYTES), zlib.decompressobj(31)
    while raw:
        out = plain.decompress(raw, READ_BYTES)
        if out:
            yield out
        if plain.eof:
            raw, plain = plain.unused_data or read(READ_BYTES), zlib.decompressobj(31)
        else:
            raw = plain.unconsumed_tail or read(READ_BYTES)
            if not raw and not plain.eof:
                raise ValueError("the stream ends within a gzip member")


def records(parts: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of a plain WARC stream, one in memory at a time."""
    parts, held = iter(parts), bytearray()

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > MOST_HEADER or not more():
                if held.strip():
                    raise ValueError("the stream ends within a record")
                return
        size = int(re.search(rb"(?im)^content-length: *(\d+)\r?$", held[: end + 2])[1])
        size += end + 8
        while len(held) < size:
            if not more():
                raise ValueError("the stream ends within a record")
        yield bytes(held[:size])
        del held[:size]


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in headers.items()}
    return headers, rest[: int(headers["content-length"])]


def _deflated(parts: Iterable[bytes], level: int) -> Iterator[bytes]:
    press = zlib.compressobj(level, wbits=31)
    for part in parts:
        if out := press.compress(part):
            yield out
    yield press.flush()


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), []
        # a cut of the rows by bytes is a file
        for batch in chunks(batches, "html", ARCHIVE_BYTES):
            rows = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), utf8(batch.column("html")), batch.column("of").to_pylist(), strict=True)
            name = f"part-{part:08d}-{len(files):06d}.warc.gz"
            put_file(f"{folder}/{name}", _deflated((record(p, u, h or b"", r) for p, u, h, r in rows), 1))
            files.append((name, batch.num_rows))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], names=["file", "records"])

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; returns file and records of each."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    pages = pages.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    groups = pages.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 AND last IS NOT NULL")
    groups = staged(groups.select("sha", "last"), "payloads")
    of = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = pages.join(groups, "sha", "left").select("page_id", "url", "html", of.alias("of"))
    return staged(rows.transform(in_arrow, _write(folder), "file string, records long"), "archives")


def normalised(source: str, target: str) -> int:
    """Rewrite one archive record by record, with a sidecar index of lines of JSON."""
    lines: list[bytes] = []

    def members() -> Iterator[bytes]:
        at = 0
        with open_file(source) as file:
            for raw in records(inflated(file.read)):
                headers, _ = parsed(raw)
                member = b"".join(_deflated([raw], 6))
                lines.append(json.dumps([at, len(member), headers["warc-type"], headers["warc-record-id"]]).encode() + b"\n")
                at += len(member)
                yield member

    put_file(target, members())
    put_file(target + ".idx", lines)
    return len(lines)


def _normalise(target: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[-1]
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [normalised(path, f"{target}/{name}")]})

    return run


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Every archive of ``source`` with a member for each record in ``target``; returns file and records."""
    return staged(_paths(spark, source, "*.warc.gz").transform(in_arrow, _normalise(target), "file string, records long"), "normalised")


def _paths(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    # only names and sizes of the files are read here
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


PAGES = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _page(raw: bytes) -> tuple:
    headers, block = parsed(raw)
    number = lambda x: None if x is None or x == f"<{ID}->" else int(x[len(ID) + 1 : -1])
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"{headers['warc-record-id']}: the payload is not the one that was written")
    else:
        payload = None
    return number(headers["warc-record-id"]), headers.get("warc-target-uri"), payload, size, digest, headers["warc-type"], number(headers.get("warc-refers-to"))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in PAGES.split(", ")]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with open_file(path) as index:
                places = [json.loads(x) for x in index.read().splitlines()]
            with open_file(path.removesuffix(".idx")) as file:
                for at in range(0, len(places), 500):
                    rows = [_page(zlib.decompress(file.read_at(n, offset), 31)) for offset, n, _, _ in places[at : at + 500]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all normalised archives, fetched by their sidecar indexes; payload is null for revisits."""
    return _paths(spark, folder, "*.idx").transform(in_arrow, _read, PAGES)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = scratch(spark, "warc"), scratch(spark, "warc-members")
    if write(table(spark, sf_dir, "pages"), source).isEmpty():
        return spark.createDataFrame([], PAGES).drop("url", "payload")
    normalise(spark, source, target)
    return read(spark, target).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
