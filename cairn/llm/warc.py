"""Legacy ARC archives to WARC: header lines of either ARC version, declared lengths, and the WARC
identifiers, timestamps, types and digests that follow from them.

Archives are written by Spark's text sink, whose record separator is exactly what ends an ARC or a
WARC record, as one gzip stream a file; they are read as binary files, inflated piece by piece and cut by
declared lengths, so that a task holds one compressed archive and one record."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import arrow_batch, new_folder, staged, table

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
ARCHIVED = "20240101000000"
#: The names in the URL-record line of each ARC version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINES = pa.schema([("value", pa.binary())])
SEEN = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("size", pa.int64())])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Inflated:
    """Bytes of a gzip file (of any number of members) or a plain one, taken in turn; only what was asked for is held."""

    def __init__(self, data: bytes, piece: int = 1 << 16):
        self.data, self.piece, self.at, self.buffer, self.offset = memoryview(data), piece, 0, bytearray(), 0
        self.packed = data[:2] == b"\x1f\x8b"
        self.gzip = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.piece]
        self.at += len(part)
        while self.packed and len(part):
            self.buffer += self.gzip.decompress(part)
            part = self.gzip.unused_data
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
        if not self.packed:
            self.buffer += part
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += len(out)
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with the mark, or what is left."""
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                return self.take(len(self.buffer))
        return self.take(i + len(mark))


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and content of each record of an ARC file but its version block, which names the version."""
    source, fields = Inflated(data), ARC_FIELDS[1]
    while True:
        at, line = source.offset, source.until(b"\n")
        if not line:
            return
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").strip().split(" ")
        if parts[0].startswith("filedesc:"):
            block = source.take(int(parts[-1]))
            fields = ARC_FIELDS.get(int(block.split(b" ", 1)[0] or b"1"), ARC_FIELDS[1])
            continue
        head = dict(zip(fields, parts, strict=False))
        yield at, head, source.take(int(parts[-1]))


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    source = Inflated(data)
    while head := source.until(b"\r\n\r\n").lstrip(b"\r\n"):
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        yield fields, source.take(int(fields["content-length"]))
        source.take(4)


def http_parts(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, header bytes and body of an HTTP response."""
    head, mark, body = content.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, head + mark, body


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit("/", 1)[-1]}:{offset}')}>"


def timestamp(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(arc_date) :])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _arc(version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = []
                if first:
                    block = f"{version} 0 cairn\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
                    more = "200 - - 0 cairn.arc " if version == 2 else ""
                    rows, first = [f"filedesc://cairn.arc 0.0.0.0 {ARCHIVED} text/plain {more}{len(block)}\n".encode() + block], False
                for page, url, html in zip(*(batch.slice(at, 512)[c] for c in ("page_id", "url", "html")), strict=True):
                    body = html.as_py() or b""
                    own = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode() + body
                    more = f"200 {sha1(body)} - 0 cairn.arc " if version == 2 else ""
                    target = re.sub(r"[\x00-\x20\x7f]", "%20", url.as_py() or "about:blank")
                    rows.append(f"{target} 0.0.0.0 {ARCHIVED} text/html {more}{len(content)}\n".encode() + content)
                yield arrow_batch(LINES, value=rows)

    return run


def write_arc(pages: DataFrame, version: int = 1) -> str:
    """pages (page_id, url, html, ...) as ARC files, one a partition, in a new shared folder; null html is empty."""
    where = new_folder(pages.sparkSession, "arc")
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(cast(html as string) as binary) html")
    lines = rows.mapInArrow(_arc(version), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").text(where)
    return where


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows = []
            for offset, _, block in arc_records(content.as_py()):
                fields, _, body = http_parts(block)
                page = fields.get("x-page-id")
                rows.append((path, offset, int(page) if page else None, sha1(body), len(body)))
            if rows:
                yield arrow_batch(SEEN, **dict(zip(SEEN.names, zip(*rows, strict=True), strict=True)))


def _warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for batch in batches:
        for path, content, decided in zip(batch["path"].to_pylist(), batch["content"], batch["decided"], strict=True):
            same = {d["offset"]: d for d in decided.as_py()}
            rows, size = [], 0
            if first:
                info = b"software: cairn\r\nformat: WARC File Format 1.1\r\n"
                rows, first = [f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(path, -1)}\r\nWARC-Date: {timestamp(ARCHIVED)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info], False
            for offset, head, block in arc_records(content.as_py()):
                fields, http, body = http_parts(block)
                d = same[offset]
                lines = [f"WARC-Record-ID: {record_id(path, offset)}", f"WARC-Date: {timestamp(head['Archive-date'])}", f"WARC-Target-URI: {head['URL']}", f"WARC-IP-Address: {head['IP-address']}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{d['digest']}"]
                if "x-page-id" in fields:
                    lines.append(f"X-Page-Id: {fields['x-page-id']}")
                if d["revisit"]:
                    lines = ["WARC-Type: revisit", *lines, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(d['path0'], d['offset0'])}"]
                    lines += [f"X-Refers-To-Page-Id: {d['page0']}"] if d["page0"] is not None else []
                    body = b""
                else:
                    lines = ["WARC-Type: response", *lines]
                rows.append(("WARC/1.1\r\n" + "\r\n".join([*lines, f"WARC-Block-Digest: sha1:{sha1(http + body)}", f"Content-Length: {len(http) + len(body)}"]) + "\r\n\r\n").encode() + http + body)
                size += len(rows[-1])
                if size > 1 << 22:
                    yield arrow_batch(LINES, value=rows)
                    rows, size = [], 0
            yield arrow_batch(LINES, value=rows)


def convert(spark: SparkSession, arc: str, least: int = LEAST_REVISIT) -> str:
    """The ARC files of a folder as WARC files in a new shared folder. Of records with equal payloads of `least`
    bytes or more, the one with the smallest page id (then file and offset; no id comes last) is the response."""
    files = spark.read.format("binaryFile").load(arc).select("path", "content")
    seen = staged(files.mapInArrow(_seen, "path string, offset bigint, page_id bigint, digest string, size bigint"), "records")
    first = seen.filter(F.col("size") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")).alias("first"))
    decided = seen.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("size") >= least) & ((F.col("first.path") != F.col("path")) | (F.col("first.offset") != F.col("offset")))
    record = F.struct("offset", "digest", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.col("first.page_id").alias("page0"), F.col("first.path").alias("path0"), F.col("first.offset").alias("offset0"))
    lists = decided.groupBy("path").agg(F.collect_list(record).alias("decided"))
    where = new_folder(spark, "warc")
    rows = files.join(lists, "path").mapInArrow(_warc, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(where)
    return where


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for head, block in warc_records(content.as_py()):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                fields, _, body = http_parts(block)
                page, other = head.get("x-page-id"), head.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, len(body) if kind == "response" else int(fields["content-length"]), sha1(body) if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:"), kind, int(other) if other else None))
            if rows:
                yield arrow_batch(READ, **dict(zip(READ.names, zip(*rows, strict=True), strict=True)))


def read_warc(spark: SparkSession, where: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit; a response's
    digest and length are taken from what was read, a revisit's from its headers."""
    return spark.read.format("binaryFile").load(where).select("content").mapInArrow(_read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives of the old kind, converted, and read again; see convert()."""
    return read_warc(spark, convert(spark, write_arc(table(spark, sf_dir, "pages"))))


QUERIES = {"op9_warc": op9_warc}
#: Base 32 of the digest: 32 groups of five of its 160 bits.
SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, array_to_string(list_transform(range(0, 160), lambda i: CAST((strpos('0123456789abcdef', x[i // 4 + 1]) - 1) // CAST(pow(2, 3 - i % 4) AS INTEGER) % 2 AS VARCHAR)), '') AS bits FROM p)
SELECT page_id, CAST(octet_length(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(bits[g * 5 + j + 1] AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q"""
}
