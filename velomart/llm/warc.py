"""Web archives: pages as WARC transactions, and transactions put together again.

Each page becomes three records, each a gzip member of its own: the request, the response (or a
revisit, where the same payload is stored under another page), and metadata with the page's id. Request and
metadata name the response or revisit in WARC-Concurrent-To; reading joins the three by it
and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velomart.llm.common import read_blobs, stage, write_blobs
from velomart.sinks.tables import work_folder

#: Smaller payloads are always stored.
MIN_REVISIT_BYTES = 1000
#: Uncompressed bytes that an archive file holds at most, about.
FILE_BYTES = 16_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def described(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, original): ``original`` is the page and url that store the payload, for revisits.

    Of equal payloads of ``least`` bytes and more the largest page_id stores it; rows that repeat this id
    all do. A null page_id comes before all others; if a group has only null ids, each stores it.
    """
    hashed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    # One row per digest that occurs more than once: partially aggregated, however hot a digest is.
    stored = (
        hashed.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "url")).alias("stored"), F.count("*").alias("n"))
        .where("n > 1 AND stored.page_id IS NOT NULL")
        .drop("n")
    )
    return (
        hashed.join(stored, "digest", "left")
        .withColumn("original", F.when(~F.col("page_id").eqNullSafe(F.col("stored.page_id")), F.col("stored")))
        .drop("stored")
    )


def _id(page_id: int | None, url: str | None, digest: str, kind: str) -> str:
    name = repr((page_id, url, digest, kind)).encode()
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(name).digest(), version=3)}>"


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{''.join(lines)}Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def transaction(page_id, url, payload: bytes, digest: str, original, date: str = DATE) -> list[bytes]:
    """A page's request, response or revisit, and metadata, as gzip members."""
    uri = None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")
    own = _id(page_id, url, digest, "capture")
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    capture = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", labelled), ("Content-Type", "application/http; msgtype=response")]
    try:
        parts = urlsplit(uri or "")
        host, path = parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", uri
    asked = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    fields += b"" if url is None else b"url: " + base64.b64encode(url.encode()) + b"\r\n"
    if original is None:
        stored = _record("response", capture, http + payload)
    else:
        stored = _record("revisit", [*capture, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(original["page_id"], original["url"], digest, "capture"))], http)
    return [
        _record("request", [("WARC-Record-ID", _id(page_id, url, digest, "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")], asked),
        stored,
        _record("metadata", [("WARC-Record-ID", _id(page_id, url, digest, "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], fields),
    ]


def write_archives(pages: DataFrame, date: str = DATE) -> str:
    """Write (page_id, url, html) as archive files of about ``FILE_BYTES``; returns their folder.

    Null html: an empty payload. Null url: no target URI. Equal rows are records of their own with one id;
    further columns are left out. An empty table gives no file.
    """
    path = f"{work_folder(pages.sparkSession)}/archives"

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "original")], strict=True):
                page_id, url, payload, digest, original = (x.as_py() for x in row)
                members += transaction(page_id, url, payload, digest, original, date)
                size += len(payload) + 1000
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["blob"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["blob"])

    write_blobs(described(pages).mapInArrow(files, "blob binary"), path)
    return path


def members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file one after another, zero padding left out."""
    view, at = memoryview(content), 0
    while at < len(view) and view[at] != 0:
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof and at < len(view):
            parts.append(reader.decompress(view[at : at + step]))
            at += min(step, len(view) - at) - len(reader.unused_data)
        if not reader.eof:
            raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def parsed(record: bytes) -> dict[str, object]:
    """A record's headers by lower-case name, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return found | {"block": rest[: int(found["content-length"])]}


RECORD = (
    "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, "
    "page_id long, url string, payload_bytes long, payload_digest string, request string, payload binary"
)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives. A response's payload size and digest are taken from its payload.

    Raises if they differ from what the record states.
    """

    def fields(block: bytes) -> dict[str, str]:
        return {k: v for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n") if line)}

    def row(r: dict) -> dict:
        kind, block = r["warc-type"], r["block"]
        out = {
            "record_id": r["warc-record-id"], "type": kind, "date": r.get("warc-date"), "uri": r.get("warc-target-uri"),
            "concurrent_to": r.get("warc-concurrent-to"), "refers_to": r.get("warc-refers-to"),
        }
        if kind == "metadata":
            said = fields(block)
            page_id, url = said.get("page-id"), said.get("url")
            out |= {"page_id": page_id and int(page_id), "url": None if url is None else base64.b64decode(url).decode()}
        elif kind == "request":
            out["request"] = block.decode()
        else:
            head, _, payload = block.partition(b"\r\n\r\n")
            out["payload_bytes"] = int(fields(head.partition(b"\r\n")[2])["Content-Length"])
            out["payload_digest"] = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
            if kind == "response":
                if (len(payload), hashlib.sha1(payload).hexdigest()) != (out["payload_bytes"], out["payload_digest"]):
                    raise ValueError(f"{out['record_id']}: the payload is not the one stated")
                out["payload"] = payload if payloads else None
        return out

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("blob"):
                yield pa.RecordBatch.from_pylist([row(parsed(m)) for m in members(content.as_py())], ARROW)

    ARROW = pa.schema([(k, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[v]) for k, v in (c.split() for c in RECORD.split(", "))])
    return read_blobs(spark, path).select("blob").mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture, request, metadata): one nested row per response or revisit, by concurrent-to identifiers.

    A capture without request or metadata has null there; if several name it, one of them is taken.
    """
    capture = records.where("type IN ('response', 'revisit')").select(
        F.struct("record_id", "type", "date", "uri", "refers_to", "payload_bytes", "payload_digest", "payload").alias("capture")
    )

    def naming(kind: str, columns: list[str]) -> DataFrame:
        return (
            records.where(F.col("type") == kind)
            .groupBy(F.col("concurrent_to").alias(f"{kind}_of"))
            .agg(F.min(F.struct(*columns)).alias(kind))
        )

    return (
        capture.join(naming("request", ["record_id", "request"]), F.col("capture.record_id") == F.col("request_of"), "left")
        .join(naming("metadata", ["record_id", "page_id", "url"]), F.col("capture.record_id") == F.col("metadata_of"), "left")
        .drop("request_of", "metadata_of")
    )


def captures(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``assemble`` over archive files, with ``refers_to_page``: the page whose response a revisit refers to."""
    whole = assemble(stage(read_records(spark, path, payloads), "records"))
    stored = (
        whole.where("capture.type = 'response'")
        .groupBy(F.col("capture.record_id").alias("stored_id"))
        .agg(F.max("metadata.page_id").alias("refers_to_page"))
    )
    return whole.join(stored, F.col("capture.refers_to") == F.col("stored_id"), "left").drop("stored_id")


SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), s AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS stored FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND page_id <> stored THEN stored END AS refers_to
FROM s
"""
