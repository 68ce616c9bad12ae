"""Operator 5: WARC archives, one gzip member per record, and their sequential reader.

The writer gives each record its own gzip member. Spark's text sink writes the members as they are, with a zero byte
after each. That byte is the member's own last one: the highest of its length, which is zero below 16 MB and left to the
sink; a longer record is followed by an empty member, whose length ends in zero too. So the files are plain gzip, lie
wherever Spark can write, and no executor opens a path by itself. A file holds so many records of mean length as fill
FILE_BYTES. The reader goes through a file once: it inflates in small steps, frames a record by its
Content-Length, hashes the payload on the way and compares it with the record's digest.

Payloads that are equal and at least `least` bytes long are stored once, with the largest id; the others become revisit
records. Defined results: a null payload is empty; a null id loses against any other, and of rows with equal payload and
equal largest id all are responses; a null address leaves the header out; other columns are not carried; an empty table
gives no archive and an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.llm.common import cut, shared_dir, table

#: More repeated payloads than this are joined by a shuffle and not broadcast.
BROADCAST_ROWS = 50_000
FILE_BYTES = 64 << 20
SEPARATOR = "\x00"
EMPTY = gzip.compress(b"", mtime=0)
STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the response's header lines and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    if page is not None:
        lines.append(f"X-Page: {page}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def line(member: bytes) -> bytes:
    """The member without its last byte, which the sink's separator adds."""
    return (member if member[-1] == 0 else member + EMPTY)[:-1]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the pages as archives in a folder."""
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    groups = base.where(F.length("payload") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page").alias("last")).where("n > 1")
    repeated = cut(groups.select("digest", "last", F.lit(True).alias("again")))
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = base.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    refers = F.when(F.col("again") & ~F.col("page").eqNullSafe(F.col("last")), F.col("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                raw = [line(record(x["page"], x["url"], x["payload"], digest32(bytes.fromhex(x["digest"])), x["refers"], date)) for x in part]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    members = joined.select("page", "url", "payload", "digest", refers.alias("refers")).mapInArrow(run, "raw binary")
    mean = pages.agg(F.avg(F.octet_length(F.col(payload_col)))).first()[0] or 0
    members.select(F.col("raw").cast("string")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1000)))).text(path)
    _rename(pages.sparkSession, path)


def _rename(spark: SparkSession, path: str) -> None:
    """Give the sink's files the archives' name."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


class Members:
    """The bytes of a file of gzip members, inflated in steps; one member after the other."""

    def __init__(self, content: memoryview) -> None:
        self.content, self.at, self.buffer, self.inflate = content, 0, bytearray(), None

    def next_member(self) -> bool:
        """Open the next member that isn't empty."""
        while self.at < len(self.content):
            self.inflate, self.buffer = zlib.decompressobj(31), bytearray()
            while not self.buffer and self.more():
                pass
            if self.buffer:
                return True
        return False

    def more(self) -> bool:
        """Inflate one more step of this member; False at its end."""
        if self.inflate.eof:
            return False
        if self.inflate.unconsumed_tail:
            step = self.inflate.unconsumed_tail
        else:
            step = self.content[self.at : self.at + STEP]
            self.at += len(step)
        out = self.inflate.decompress(step, STEP)
        self.buffer += out
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return bool(len(step) or out)

    def until(self, mark: bytes) -> bytes:
        while (k := self.buffer.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record ends inside its header")
        out = bytes(self.buffer[:k])
        del self.buffer[: k + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, as they come."""
        while n > 0:
            if not self.buffer and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part

    def drain(self) -> bytes:
        while self.more():
            pass
        return bytes(self.buffer)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def records(content: memoryview, keep: bool = False) -> Iterator[dict]:
    """The records of one archive, in order, each verified against its digest."""
    file = Members(content)
    while file.next_member():
        head = _headers(file.until(b"\r\n\r\n"))
        length = int(head["content-length"])
        block = file.take(length)
        http, body = bytearray(), bytearray()
        sha, size = hashlib.sha1(), 0
        inside = False
        for part in block:
            if not inside:
                http += part
                k = http.find(b"\r\n\r\n")
                if k < 0:
                    continue
                inside, part, http = True, bytes(http[k + 4 :]), http[:k]
            sha.update(part)
            size += len(part)
            if keep:
                body += part
        if file.drain() != b"\r\n\r\n":
            raise ValueError("a record isn't followed by two line ends")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        response = head["warc-type"] == "response"
        if response and digest != digest32(sha.digest()):
            raise ValueError(f"the payload of {head['warc-record-id']} doesn't have the digest of its record")
        yield {
            "page": int(head["x-page"]) if "x-page" in head else None, "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
            "payload_bytes": size if response else int(_headers(bytes(http))["content-length"]), "payload_digest": digest,
            "refers_to": int(head["x-refers-to-page"]) if "x-refers-to-page" in head else None, "payload": bytes(body) if keep and response else None,
        }


def read_archives(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """One row per record of the archives in a folder; with their payloads if kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("page", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                for row in records(memoryview(content.as_buffer()), keep):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(run, "page long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def unresolved(records: DataFrame) -> DataFrame:
    """The revisit records without a response of the page and digest that they refer to."""
    there = records.where("record_type = 'response'").select(F.col("page").alias("refers_to"), "payload_digest").distinct()
    return records.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
#: Base 32 from the hexadecimal digest: five bits from two neighbouring digits.
ORACLES = {"op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT h, i, (instr('0123456789abcdef', substr(h, (5 * i) // 4 + 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, (5 * i) // 4 + 2, 1)) - 1 AS two, 3 - (5 * i) % 4 AS shift FROM (SELECT DISTINCT h FROM p), range(32) r(i)),
b32 AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((two >> shift) & 31 AS BIGINT) + 1, 1), '' ORDER BY i) AS payload_digest FROM bits GROUP BY h),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN b32 USING (h) JOIN g USING (h)"""}
