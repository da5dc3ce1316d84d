"""WARC archives: a writer of one gzip member a record, and a sequential reader that checks framing and digests."""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, in_slices

#: Bytes of an archive before the writer starts another.
ARCHIVE_BYTES = 4 << 20
#: Bytes that are handed to the decompressor at a time.
CHUNK = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(head.encode() + block + b"\r\n\r\n") + c.flush()


def _members(data: bytes) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces it inflates to; the next one starts where it ended."""
    at = 0

    def pieces() -> Iterator[bytes]:
        nonlocal at
        d = zlib.decompressobj(31)
        while not d.eof:
            if not (part := data[at : at + CHUNK]):
                raise ValueError("the archive ends inside a member")
            at += len(part)
            while part and not d.eof:
                yield d.decompress(part, CHUNK)
                part = d.unconsumed_tail
        at -= len(d.unused_data)

    while at < len(data):
        yield pieces()


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers in lower case, block, error) of each record. Raises ValueError where an archive can't be followed further."""
    for pieces in _members(data):
        buffer = bytearray()
        for piece in pieces:
            seen = max(0, len(buffer) - 3)
            buffer += piece
            if buffer.find(b"\r\n\r\n", seen) >= 0:
                break
        head, mark, rest = bytes(buffer).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not mark or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if not headers.get("content-length", "").isdigit():
            raise ValueError("no content length")
        length = int(headers["content-length"])
        block = bytearray(rest)
        for piece in pieces:
            block += piece
            if len(block) > length + 4:
                raise ValueError("more bytes than the content length")
        error = None
        if bytes(block[length:]) != b"\r\n\r\n":
            error = f"content length {length}, {max(0, len(block) - 4)} bytes found"
        block = bytes(block[:length])
        if error is None and (said := headers.get("warc-block-digest")) and said != "sha1:" + base32_sha1(block):
            error = "block digest differs"
        yield headers, block, error


RECORDS = "page_id long, record_type string, target_uri string, payload binary, payload_bytes long, payload_digest string, refers_to long, error string"


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives (name, archive) of a (page_id, url, html) table, kept in the shared folder.

    Of the rows whose html has the same bytes, at least least_bytes, the one of the smallest page_id is a response
    and the others revisit it by digest and id, without a payload; shorter ones are all responses. Null html is
    empty. Repeated rows of a page_id go each by its own payload: of rows with equal id and payload, all are responses where the id is the
    payload's smallest, as they name no other record. Rows with a null page_id are responses unless another row has
    the payload. An empty table gives no archives; columns with other names are ignored. A payload of any length is one record, held by one task. Which rows are revisits is
    settled on (id, digest) rows before the html is joined by these, so a payload that
    a third of the pages share moves no html to one place; rows of one digest are counted down to their
    first before they meet.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 256)
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    slim = cut(own.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= least_bytes), "digests")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    revisits = slim.join(first, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), "digest", F.col("first").alias("refers_to")).distinct()
    named = own.withColumn("digest", F.sha1("payload"))
    same = named["page_id"].eqNullSafe(revisits["id"]) & (named["digest"] == revisits["digest"])
    joined = named.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to", F.expr("uuid()").alias("record"))

    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def archive() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(data).hexdigest()}.warc.gz"]), pa.array([data], pa.binary())], ["name", "archive"])

        for batch in in_slices(batches):
            for page_id, url, payload, refers_to, one in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base32_sha1(payload)
                headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{one}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                headers += [("X-Page-ID", str(page_id))] if page_id is not None else []
                headers += [("WARC-Target-URI", " ".join(url.split()))] if url else []
                if refers_to is not None:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
                    payload = b""
                parts.append(record([*headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(payload)}")], payload))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size = [], 0
        if parts:
            yield archive()

    return cut(joined.mapInArrow(write, "name string, archive binary"), "archives")


def read_archives(archives: DataFrame, content_col: str = "archive") -> DataFrame:
    """One row for each record of each archive (the bytes of a .warc.gz, as spark.read.format("binaryFile") gives them, too): page_id, record_type, target_uri, payload, payload_bytes, payload_digest, refers_to, error.

    A record whose framing or digest is wrong has error; where an archive can't be followed further, a last row
    has just error. A revisit has no payload, its size and digest are those of its response. Null content has no records.
    """
    bounded_batches(archives.sparkSession, 4)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None

    def rows(data: bytes) -> Iterator[tuple]:
        try:
            for h, block, error in read_records(data):
                kind = h.get("warc-type")
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if error is None and kind == "response" and digest != base32_sha1(block):
                    error = "payload digest differs"
                n = number(h.get("x-payload-length")) if kind == "revisit" else len(block)
                yield number(h.get("x-page-id")), kind, h.get("warc-target-uri"), None if kind == "revisit" else block, n, digest, number(h.get("x-refers-to-page")), error
        except (ValueError, zlib.error) as e:
            yield *[None] * 7, str(e)[:200]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                held = []
                for row in rows(data or b""):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    return archives.select(content_col).mapInArrow(read, RECORDS)
