"""WARC archives: writing records, reading them back, and assembling transactions.

Writing.  A page becomes three records: a request, a response (or a revisit, if an earlier page has the same payload of at
least ``LEAST_REVISIT`` bytes) and a metadata record; request and metadata name the capture in WARC-Concurrent-To.  Spark's
text writer stores the records with CRLF as line end, gzipped: a record ends with one CRLF of its own and the writer's.  Pages
are written by classes of payload size (``SIZES``), each with as many pages a file as make ``FILE_BYTES`` at most, so that a
file is bounded by bytes (or holds one page) however large the pages are.  Payload digests are grouped with the smallest page_id before anything is joined; pages that
revisit meet their decision by page_id and digest, so that payloads move only if these pages are too many to broadcast.
Record ids are hashes of kind, page_id and digest, so a task that runs again writes the same records.

Reading.  Archives are read as whole files; each is unzipped as a stream (any number of gzip members) and cut by
Content-Length, never by what a payload looks like.  Memory: a zipped archive and the record at hand.

Assembly.  Captures are the response, revisit and resource records.  Requests and metadata reach their capture by their own
WARC-Concurrent-To, by the capture's, or, metadata, by way of a request.  One nested row per capture record comes out.

Defined results: a NULL html is an empty payload; a NULL url leaves WARC-Target-URI out, and line ends in one are
percent-encoded.  Rows that repeat a page_id and payload have the same record ids and come out as often as they went in; where
they have the group's smallest page_id, each is a response.  NULL page_ids count as largest.  A record id that
several request or metadata records share counts once.  Extra columns of ``pages`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import materialize, ship_package, table
from equipoise.session import scratch_path

LEAST_REVISIT = 100
SIZES = (64 << 10, 1 << 20, 16 << 20)
FILE_BYTES = 192 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
FEED, BATCH_BYTES = 1 << 20, 4 << 20
CAPTURES = ("response", "revisit", "resource")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), bytes, digest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"),
                        F.sha2(payload, 256).alias("digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): the pages whose payload an earlier page has, and that page."""
    narrow = materialize(payloads(pages).filter(F.col("bytes") >= LEAST_REVISIT).select("page_id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 AND first IS NOT NULL")
    return narrow.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()


def record_id(kind: str, page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without its last CRLF, as a string of bytes; headers whose value is NULL are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise("") for k, v in headers]
    size = F.octet_length(block).cast("string")
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block, F.lit(CRLF))


def records(pages: DataFrame, again: DataFrame) -> DataFrame:
    """(record): the WARC records of ``pages`` (page_id, url, html), three a row; ``again``: their ``revisits``."""
    again = again.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "first")
    rows = payloads(pages)
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["__page"]) & (rows["digest"] == again["__digest"]), "left")
    seen = F.col("__digest").isNotNull()
    page, digest = F.col("page_id"), F.col("digest")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    kind = F.when(seen, "revisit").otherwise("response")
    capture = F.when(seen, record_id("revisit", page, digest)).otherwise(record_id("response", page, digest))
    request = record_id("request", page, digest)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(DATE))]
    response = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", capture), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
         ("WARC-Refers-To", F.when(seen, record_id("response", F.col("first"), digest))),
         ("WARC-Profile", F.when(seen, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.concat(http, F.when(seen, F.lit("")).otherwise(F.col("payload").cast("string"))))
    host = F.regexp_extract(F.coalesce(uri, F.lit("")), r"://([^/?#\s]*)", 1)
    asked = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", request), *common, ("WARC-Concurrent-To", capture),
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)))
    told = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", page, digest)), *common,
         ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page_id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(CRLF)))
    return rows.select(F.explode(F.array(asked, response, told)).alias("record"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, sizes: tuple[int, ...] = SIZES) -> None:
    """Write the records of ``pages`` as gzipped WARC files in the folder ``path``, one folder in it a class of sizes.

    A class has the payloads up to its size of ``sizes``, so many a file that they make ``file_bytes`` at most; those beyond the
    last size are one a file.
    """
    again = materialize(revisits(pages), "revisits")
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    kind = sum(((size > bound).cast("int") for bound in sizes), F.lit(0))
    used = {row[0] for row in pages.select(kind).distinct().collect()} | {0}  # one row a class
    for i in sorted(used):
        per_file = max(1, file_bytes // sizes[i]) if i < len(sizes) else 1
        (records(pages.filter(kind == i), again).write.option("lineSep", CRLF).option("compression", "gzip")
         .option("maxRecordsPerFile", 3 * per_file).text(f"{path}/size-{i}"))


class _Unzipped:
    """A stream over the bytes of an archive: gzip members one after the other, or plain."""

    def __init__(self, content: bytes):
        self.content, self.at, self.ready = memoryview(content), 0, bytearray()
        self.zipped = content[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.content):
            return False
        part = self.content[self.at:self.at + FEED]
        self.at += len(part)
        if not self.zipped:
            self.ready += part
            return True
        self.ready += self.unzip.decompress(part)
        if self.unzip.eof:  # another member may follow
            self.at -= len(self.unzip.unused_data)
            self.unzip = zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``, which is skipped too; None at the end."""
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if not self._more():
                return None
        out = bytes(self.ready[:at])
        del self.ready[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n and self._more():
            pass
        if len(self.ready) < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def parse_archive(content: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of each record of an archive."""
    stream = _Unzipped(content)
    while (head := stream.upto(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:  # the two line ends after the record before
            continue
        lines = head.decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        headers = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines[1:])]
        yield headers, stream.take(int(dict(headers)["content-length"]))


RECORD_SCHEMA = ("record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
                 "payload_digest string, content_type string, http_headers string, payload binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in the folder ``path``; ``payload`` is the block after the HTTP headers, if it has such."""
    ship_package(spark)
    schema = spark.createDataFrame([], RECORD_SCHEMA).schema
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.string()] * 4 + [pa.binary()]
    names = schema.names

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for headers, block in parse_archive(content.as_py()):
                    one = dict(headers)
                    http, payload = None, block
                    if one.get("content-type", "").startswith("application/http"):
                        first, _, payload = block.partition(b"\r\n\r\n")
                        http = first.decode("utf-8", "replace")
                    held.append((one.get("warc-record-id"), one.get("warc-type"), one.get("warc-target-uri"), one.get("warc-date"),
                                 [v for k, v in headers if k == "warc-concurrent-to"], one.get("warc-refers-to"),
                                 one.get("warc-payload-digest"), one.get("content-type"), http, payload))
                    size += len(block) + 500
                    if size >= BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
        if held:
            yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    # the writer's names: this reader takes zipped files by their first bytes, not by their name
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(rows_of, schema)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture record: capture, requests, metadata (arrays of the records that are concurrent to it).

    ``found`` has record_id, type, concurrent_to and any other columns; it should be cheap to read, or materialised.
    """
    kind = F.col("type")
    captures, satellites = found.filter(kind.isin(*CAPTURES)), found.filter(kind.isin("request", "metadata"))
    known = captures.select(F.col("record_id").alias("capture_id")).distinct()
    links = satellites.select("record_id", "type", F.explode("concurrent_to").alias("to")).distinct()
    own = links.join(known, links["to"] == known["capture_id"]).select("record_id", "type", "capture_id")
    named = captures.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id")).distinct()
    back = named.join(satellites.select("record_id", "type").distinct(), "record_id").select("record_id", "type", "capture_id")
    direct = own.unionByName(back).distinct()
    requests = direct.filter("type = 'request'").select(F.col("record_id").alias("to"), "capture_id")
    by_request = links.filter("type = 'metadata'").join(requests, "to").select("record_id", "type", "capture_id")
    placed = direct.unionByName(by_request).distinct()
    # small records: their number per capture is that of its transaction
    row = F.struct(*[F.col(c) for c in found.columns])
    once = satellites.groupBy(F.col("record_id").alias("id")).agg(F.first(row).alias("record"))
    grouped = placed.join(once, placed["record_id"] == once["id"]).groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", F.col("record")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", F.col("record")))).alias("metadata"))
    whole = captures.select("record_id", row.alias("capture"))
    empty = F.array().cast(grouped.schema["requests"].dataType)
    return whole.join(grouped, whole["record_id"] == grouped["capture_id"], "left").select(
        "capture", F.coalesce("requests", empty).alias("requests"), F.coalesce("metadata", empty).alias("metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives, read back, and assembled to one row per page."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # from here on all is read from the archives; payloads are measured where they are read
    narrow = read_archives(spark, path).select(
        "record_id", "type", "concurrent_to", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), F.substring_index("payload_digest", ":", -1).alias("stated_digest"),
        F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page_id: (-?\d+)", 1)).alias("page"))
    found = assemble(materialize(narrow, "warc-records"))
    pages = materialize(found.select(
        F.col("capture.record_id").alias("id"), F.try_to_number(F.get("metadata", F.lit(0))["page"], F.lit("S9999999999999999999")).cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("bytes"), F.col("capture.payload_digest").alias("digest"),
        F.col("capture.stated_digest").alias("stated"), F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to")), "warc-captures")
    # a revisit's payload is that of the response that it refers to
    first = pages.filter("record_type = 'response'").groupBy(F.col("id").alias("to")).agg(
        F.first("page_id").alias("refers_to"), F.first("bytes").alias("full_bytes"), F.first("digest").alias("full_digest"))
    # only revisits are joined: the others refer to nothing and would all meet at the NULL key
    again = pages.filter(F.col("to").isNotNull()).join(first, "to", "left")
    whole = again.unionByName(pages.filter(F.col("to").isNull()), allowMissingColumns=True)
    return whole.select(
        "page_id", F.coalesce("full_bytes", "bytes").alias("payload_bytes"), F.coalesce("full_digest", "digest").alias("payload_digest"),
        "record_type", "refers_to", (F.coalesce("full_digest", "digest") == F.col("stated")).alias("digest_matches"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest AS digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to,
       true AS digest_matches
FROM d LEFT JOIN f ON payload_digest = digest AND payload_bytes >= 100
"""
