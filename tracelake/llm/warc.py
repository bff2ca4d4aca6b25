"""WARC archives: writing with revisit records, and a reader that salvages what damage leaves.

Writing goes through Spark's text writer: one value per record, and the two
CRLFs that end a record as its line separator, so the files are plain WARC files
on whatever store the shared folder is. Equal payloads of a least size are
stored once; the others become revisits.

The reader takes whole files, plain or of gzip members. Where a record fails its
checks (version line, headers, Content-Length, closing CRLFs, payload digest,
gzip checksum) it searches for the next version line or gzip member, goes on
there, and reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import base64
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

VERSION = b"WARC/1.0\r\n"
MEMBER = b"\x1f\x8b\x08"
CHUNK = 1 << 16
HTTP = "HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\n\\r\\n"
HTTP_BYTES = len(HTTP.encode().decode("unicode_escape"))
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "file string, offset long, kind string, page_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, problem string"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, uri, payload, digest, bytes, record_type, refers_to) for every row: which payloads are stored and which refer.

    Null html counts as empty. A null id can't be referred to: such a row is
    always a response. Repeated rows with the largest id of their payload are
    all responses.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("uri"), F.coalesce(html_col, F.lit("")).alias("payload"))
    p = p.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "bytes": F.octet_length("payload").cast("long")})
    shared = p.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("page_id").alias("n")).where("n > 1").drop("n")
    # Written first, so that Spark knows its size: a small table of shared payloads is broadcast, and the payloads stay where they are.
    shared = materialize(shared, "payloads")
    j = p.join(shared, ["digest", "bytes"], "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return j.withColumn("refers_to", refers).withColumn("record_type", F.when(refers.isNull(), "response").otherwise("revisit")).drop("first")


#: A file holds payloads of at most FILE bytes, or one longer one.
FILE = 256 << 20


def write_archives(records: DataFrame, path: str, per_file: int = 4000, compression: str | None = None) -> None:
    """Write planned records under path, those of a size class together: a file holds per_file records and FILE bytes of payloads at most."""
    longest, low, most = records.agg(F.max("bytes")).first()[0] or 0, 0, per_file
    while low <= longest:
        high = FILE // most if most > 1 else longest + 1
        _write(records.where((F.col("bytes") >= low) & (F.col("bytes") < high)), path, most, compression)
        low, most = high, max(1, most // 16)


def _write(records: DataFrame, path: str, per_file: int, compression: str | None) -> None:
    clean = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", "")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    crlf = F.lit("\r\n")
    http = F.lit(HTTP.encode().decode("unicode_escape"))
    stored = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), crlf,
        F.lit("WARC-Record-ID: "), urn("page_id"), crlf,
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), clean, crlf,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf,
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), urn("refers_to"), crlf)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(stored) + HTTP_BYTES).cast("string"), F.lit("\r\n\r\n"),
    )
    w = records.select(F.concat(head, http, stored).alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file)
    (w.option("compression", compression) if compression else w).text(path)


_LENGTH = re.compile(rb"\d+")


def _members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, content) of gzip members; content None for bytes that no member covers."""
    at, gap = 0, None
    while at < len(data):
        z = zlib.decompressobj(31)
        try:
            if not data.startswith(MEMBER, at):
                raise zlib.error("no member")
            parts, fed = [], at
            while not z.eof and fed < len(data):
                parts.append(z.decompress(data[fed : fed + CHUNK]))
                fed += CHUNK
            if not z.eof:
                raise zlib.error("cut off")
        except zlib.error:
            gap = at if gap is None else gap
            nxt = data.find(MEMBER, at + 1)
            at = len(data) if nxt < 0 else nxt
            continue
        if gap is not None:
            yield gap, at, None
            gap = None
        end = min(fed, len(data)) - len(z.unused_data)
        yield at, end, b"".join(parts)
        at = end
    if gap is not None:
        yield gap, len(data), None


def _record(data: bytes, at: int) -> tuple[int, dict[bytes, bytes], bytes]:
    """(end, headers, block) of the record at a place; ValueError says what is wrong."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        raise ValueError("headers do not end")
    headers = {}
    for line in data[at + len(VERSION) : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    size = headers.get(b"content-length", b"")
    if not _LENGTH.fullmatch(size) or len(size) > 18:
        raise ValueError("bad Content-Length")
    body = close + 4
    end = body + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end where Content-Length says")
    block = data[body:end]
    payload = block.partition(b"\r\n\r\n")[2] if b"application/http" in headers.get(b"content-type", b"") else block
    digest = headers.get(b"warc-payload-digest", b"").decode("ascii", "replace")
    if digest.lower().startswith("sha1:") and headers.get(b"warc-type") != b"revisit":
        said = digest[5:]
        if (said.lower() != hashlib.sha1(payload).hexdigest()) and said.upper() != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError("payload digest differs")
    return end + 4, headers, payload


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes | None, str | None]]:
    """(offset, end, headers, payload, None) of records and (offset, end, None, None, problem) of gaps, in order, covering every byte.

    In gzip files, offsets are those of the member.
    """
    if data[:2] == MEMBER[:2] or (data[: len(VERSION)] != VERSION and 0 <= data.find(MEMBER) < (data.find(VERSION) if VERSION in data else len(data))):
        for start, end, content in _members(data):
            if content is None:
                yield start, end, None, None, "no valid gzip member"
            else:
                for _, _, h, p, problem in salvage(content) if content[:2] != MEMBER[:2] else [(0, 0, None, None, "nested gzip")]:
                    yield start, end, h, p, problem
        return
    at, gap, why = 0, None, None
    while at < len(data):
        try:
            end, headers, payload = _record(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            nxt = data.find(VERSION, at + 1)
            at = len(data) if nxt < 0 else nxt
            continue
        if gap is not None:
            yield gap, at, None, None, why
            gap = None
        yield at, end, headers, payload, None
        at = end
    if gap is not None:
        yield gap, len(data), None, None, why


def _urn(value: bytes | None) -> str | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return m[1].decode() if m else None


def read_archives(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """One row per record, and one of kind "gap" per quarantined stretch (offset, payload_bytes its length, problem why).

    Records of other writers may lack any header: what is absent is null, or
    empty for uri and digest. Repeated records are repeated rows. No files, or
    empty ones: no rows.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b.path, b.content):
                rows, size = [], 0
                for at, end, h, payload, problem in salvage(bytes(data)):
                    if h is None:
                        rows.append((file, at, "gap", None, None, None, None, end - at, None, problem))
                    else:
                        digest = h.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
                        rows.append((file, at, h.get(b"warc-type", b"").decode("ascii", "replace"), _urn(h.get(b"warc-record-id")), _urn(h.get(b"warc-refers-to")), h.get(b"warc-target-uri", b"").decode("utf-8", "replace"), digest, len(payload), payload, None))
                        size += len(payload)
                    if size > 16 << 20:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=COLUMNS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(parse, RECORD)


COLUMNS = [c.split()[0] for c in RECORD.split(", ")]
