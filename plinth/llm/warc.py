"""WARC archives: writing captures with payload de-duplication, and assembling transactions from the records.

Writing: each page becomes a request, a response (or a revisit of an equal payload) and a metadata record; request and
metadata point at the capture through WARC-Concurrent-To.  Which capture is the response is settled on a narrow table
(page, digest, size) alone; payloads are shuffled once, and only to the responses.  Every record is a gzip member of
its own, as archive readers expect, so a reader may start at any record.  Spark's text writer puts the members into
files through its own commit protocol, to any store Spark writes to: its line separator is the NUL that ends a member's
length field.  Files hold about FILE_BYTES of payload.

Reading: every file is parsed as a stream by Content-Length; records are joined on their identifiers to one nested row
a capture, and a revisit takes its payload's size from the response it refers to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import delete, fresh_path, ship
from .common import blocks, discard, with_columns, written

CRLF = b"\r\n"
END = CRLF + CRLF
FILE_BYTES = 128 << 20
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_id string, record_type string, page_id long, target_uri string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, computed_digest string, content binary"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


_EMPTY = _member(b"")


def unended_member(data: bytes) -> bytes:
    """A gzip member of data without its last byte, a NUL.  That byte is the length's highest one; records of 16 MiB and
    more have another there, so an empty member follows them."""
    member = _member(data)
    return member[:-1] if not member[-1] else member + _EMPTY[:-1]


def _one_line(value: str | None) -> str:
    """A header value: line ends and controls would break the record, so they are escaped."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + CRLF + block


def record_id(kind: str, key: str) -> str:
    h = hashlib.md5(f"{kind}:{key}".encode(), usedforsecurity=False).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def capture_records(page_id: int | None, name: str, url: str | None, payload: bytes | None, sha1: str, size: int, first: str) -> list[bytes]:
    """The records of the capture called `name`; `first` names the one whose payload it repeats (itself if none)."""
    own, uri, checksum = record_id("capture", name), _one_line(url), "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    target = [("WARC-Target-URI", uri)] if uri else []
    page = [] if page_id is None else [("X-Page-ID", str(page_id))]
    path = uri.partition("://")[2].partition("/")[2] if "://" in uri else ""
    request = f"GET /{path} HTTP/1.1\r\nHost: {uri.partition('://')[2].partition('/')[0]}\r\n\r\n".encode()
    same = [("WARC-Payload-Digest", checksum), ("Content-Type", "application/http;msgtype=response")]
    if first == name:
        capture = _record("response", own, [*target, *page, *same], HTTP_HEAD + (payload or b""))
    else:
        again = [("WARC-Refers-To", record_id("capture", first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        capture = _record("revisit", own, [*target, *page, *again, *same], HTTP_HEAD)
    return [
        _record("request", record_id("request", name), [*target, *page, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], request),
        capture,
        _record("metadata", record_id("metadata", name), [*target, *page, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"fetchTimeMs: 0\r\npayloadBytes: {size}\r\n".encode()),
    ]


def _write(batches):
    for batch in batches:
        rest = [batch.column(c) for c in ("page_id", "name", "url", "sha1", "n", "first")]
        at = 0
        for (texts,) in blocks(batch, ["html"], 4 << 20):
            own = [c.slice(at, len(texts)).to_pylist() for c in rest]
            at += len(texts)
            records = [unended_member(r + END) for page, name, url, sha1, n, first, html in zip(*own, texts, strict=True) for r in capture_records(page, name, url, html, sha1, n, first)]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Archives of pages (page_id, url, html).  Among rows with equal payloads of at least least_bytes bytes, the first
    by page_id (nulls last) is the response and the others revisit it, also those that repeat it wholly.  A null html is
    an empty payload; every row is a capture of its own, also of a page_id that others share or of none; a payload of
    any length is one record; an empty table writes files without records."""
    ship(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = with_columns(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("n"), html.alias("html"))
    keyed = keyed.withColumn("row", F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("url")), "sha1"))
    # a row's number is fixed once it is written; `row` is alike for rows that wholly repeat each other
    narrow = written(keyed.drop("html").withColumn("seq", F.monotonically_increasing_id()), "captures")
    name = lambda seq: F.concat_ws("|", "row", seq.cast("string"))
    firsts = narrow.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "seq")).alias("f"), F.count("*").alias("c"))
    firsts = firsts.where("c > 1").select("sha1", F.concat_ws("|", "f.row", F.col("f.seq").cast("string")).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = narrow.withColumn("name", name(F.col("seq"))).withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    planned = written(named.join(firsts, ["sha1", "salt"], "left").select("page_id", "name", "url", "sha1", "n", F.coalesce("first", "name").alias("first"), "row"), "planned")
    bodies = keyed.groupBy("row").agg(F.first("html").alias("html"))
    columns = ["page_id", "name", "url", "sha1", "n", "first", "html"]
    responses = planned.where("first = name").join(bodies, "row").select(columns)
    revisits = planned.where("first <> name").withColumn("html", F.lit(None).cast("binary")).select(columns)
    size = narrow.agg(F.sum("n"), F.count("*")).first()
    most = max(3, int(3 * size[1] * file_bytes / max(1, size[0] or 0)))
    out = responses.unionByName(revisits).mapInArrow(_write, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("maxRecordsPerFile", min(most, 5_000_000)).text(path)
    discard(narrow, planned)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; header names in lower case.  A cut-off or foreign tail raises ValueError."""
    while True:
        line = stream.readline()
        while line in (CRLF, b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b"\n"):
            if not line:
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a block")
        yield headers, block


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header."""
    return block.partition(b"\r\n\r\n")[2]


def _rows(with_content: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                stream = io.BufferedReader(pa.BufferReader(batch.column("content")[i].as_buffer()), 1 << 20)
                if stream.peek(2)[:2] == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                rows, size = [], 0
                for h, block in parse(stream):
                    kind = h.get("warc-type", "")
                    payload = _payload(block) if kind == "response" else b"" if kind == "revisit" else block
                    page = h.get("x-page-id")
                    rows.append(
                        (h.get("warc-record-id"), kind, int(page) if page else None, h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"))
                        + ((h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, len(payload), digest(payload) if kind == "response" else None, payload if with_content else None)
                    )
                    size += len(payload)
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    return run


_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def records(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """One row a record of the archives under path, compressed (by record or as a whole) or plain; a file of at most 2 GB
    is one task's."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{part-*,*.warc,*.gz}").load(path).select("content")
    return files.mapInArrow(_rows(with_content), RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row a capture (response or revisit): its request and metadata, joined through concurrent-to, and for a
    revisit the response it refers to.  Captures without request or metadata keep nulls there; of several requests or
    metadata records of one capture the one with the least record id is taken."""
    side = lambda kind: found.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "target_uri", "content")).alias(kind))
    captures = found.where("record_type in ('response', 'revisit')").withColumnRenamed("record_id", "capture_id")
    # a payload may be revisited by most captures: they are dealt over SALTS tasks
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct()
    originals = found.where("record_type = 'response'").join(wanted, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to")).agg(F.min(F.struct(F.col("page_id"), F.col("payload_bytes"), F.col("computed_digest"))).alias("original"))
    originals = originals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = captures.where("record_type = 'revisit'").withColumn("_salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).join(originals, ["refers_to", "_salt"], "left").drop("_salt")
    captures = again.unionByName(captures.where("record_type = 'response'"), allowMissingColumns=True)
    return captures.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, has_request, has_metadata) from archives written and reread."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, least_bytes)
    found = written(records(spark, path, with_content=False), "records")
    delete(spark, path)
    rows = transactions(found)
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        "page_id",
        F.when(revisit, F.col("original.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("computed_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("original.page_id")).alias("refers_to"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )
