"""WARC archives: one gzip member per record, written and read back record by record.

Writing: payloads are hashed in the JVM; the response of each payload is the smallest page id, found by a
partial aggregation of (digest, id) so that a payload shared by a third of all pages arrives as one row per
task.  Repeated payloads meet their pages by broadcast where they are few, and then html isn't shuffled; else
those with the largest shares of all pages do, as many as those shares allow, and the others in a join of narrow
rows.  Records are packed into archives of a bounded size; an archive is a run of gzip members and is kept as
one binary row in the shared folder (``data`` can be saved as a ``.warc.gz`` file as it is).

Reading: a sequential reader feeds the bytes piece by piece to an incremental decompressor, restarts it at
each member, frames the block by Content-Length, and checks block and payload digests.  ``read_files`` reads
archives from any store that Spark can list; ``read_archives`` reads the table.

Defined results: a null html is an empty payload; extra input columns are ignored; rows that repeat a page id
each get a record, of the same type; a null page id is written as an
empty record id and is never referred to while another page holds the payload; empty tables give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import few, materialize, met, ship, slices

CRLF = b"\r\n"
VERSION = b"WARC/1.1"
#: Archives are closed when they reach this many bytes.
ARCHIVE_BYTES = 4 << 20
#: Bytes given to the decompressor at once.
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive breaks the format or a digest doesn't hold."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = VERSION + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in headers)
    head += b"Content-Length: " + str(len(block)).encode() + CRLF + CRLF
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + CRLF + CRLF) + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit that names the response it repeats."""
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if kind == "revisit":
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>"),
            ("Content-Type", "application/http;msgtype=response"),
        ]
        block = f"HTTP/1.1 200 OK\r\nX-Payload-Length: {len(payload)}\r\n\r\n".encode()
    else:
        headers.append(("Content-Type", "application/http;msgtype=response"))
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers.append(("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"))
    return record_bytes(headers, block)


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def read_warc(data: bytes | memoryview, piece: int = PIECE) -> Iterator[Record]:
    """The records of an archive in order; raises WarcError where framing or a digest fails."""
    view, at = memoryview(data), 0
    while at < len(view):
        z = zlib.decompressobj(31)
        got = bytearray()
        while not z.eof:
            if at >= len(view):
                raise WarcError("the archive ends inside a member")
            part = view[at : at + piece]
            try:
                got += z.decompress(part)
            except zlib.error as e:
                raise WarcError(f"member can't be decompressed: {e}") from e
            at += len(part) - len(z.unused_data)
        yield frame(bytes(got))


def frame(member: bytes) -> Record:
    """A decompressed member as headers and a block of Content-Length bytes."""
    end = member.find(CRLF + CRLF)
    if end < 0:
        raise WarcError("no end of the header")
    first, *lines = member[:end].split(CRLF)
    if not first.startswith(b"WARC/"):
        raise WarcError("no WARC version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError("a header line without a colon")
        headers[name.strip().decode().lower()] = value.strip().decode()
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = member[end + 4 : end + 4 + n]
    if len(block) != n or member[end + 4 + n :] != CRLF + CRLF:
        raise WarcError("Content-Length doesn't frame the block")
    want = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if want and sha1_base32(block) != want:
        raise WarcError("the block digest doesn't hold")
    return Record(headers, block)


def payload_of(record: Record) -> bytes:
    """What follows the HTTP header of a response; its digest is verified."""
    payload = record.block.partition(CRLF + CRLF)[2]
    want = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if want and sha1_base32(payload) != want:
        raise WarcError("the payload digest doesn't hold")
    return payload


def _page_id(value: str) -> int | None:
    inner = value.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner.lstrip("-").isdigit() else None


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of about ARCHIVE_BYTES from rows (page_id, url, html, kind, refers_to)."""

    def out(members: list[bytes]) -> pa.RecordBatch:
        data = b"".join(members)
        name = hashlib.sha1(data).hexdigest() + ".warc.gz"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(members)], pa.int64()), pa.array([data], pa.binary())], names=["archive", "n_records", "data"])

    members, size = [], 0
    for whole in batches:
        for batch in slices(whole, 2):
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                members.append(page_record(page_id, url, payload, sha1_base32(payload), kind, refers_to))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield out(members)
                    members, size = [], 0
    if members:
        yield out(members)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each record of the archives in column ``data``."""
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for data in batch.column(0):
            rows = []
            for r in read_warc(data.as_buffer()):
                h, kind = r.headers, r.headers.get("warc-type")
                if kind == "response":
                    payload = payload_of(r)
                    n = len(payload)
                else:
                    payload = None
                    n = next((int(x.split(b":")[1]) for x in r.block.split(CRLF) if x.lower().startswith(b"x-payload-length:")), None)
                refers = _page_id(h["warc-refers-to"]) if "warc-refers-to" in h else None
                rows.append((_page_id(h.get("warc-record-id", "")), h.get("warc-target-uri"), kind, h.get("warc-payload-digest", "").removeprefix("sha1:"), n, refers, payload))
                if len(rows) == 256:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives (archive, n_records, data), one record per row of ``pages``, in the shared folder.

    Of equal payloads of at least ``min_bytes`` bytes the one with the smallest id is the response and the
    others are revisits; smaller payloads are all responses.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = rows.withColumn("digest", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))).withColumn("big", F.octet_length("html") >= min_bytes)
    firsts = key.filter("big").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    firsts = materialize(firsts, "payloads")
    known = few(firsts)
    if known is not None:
        hits = known.select(F.col("digest").alias("hit_digest"), "first_id")
        marked = key.join(F.broadcast(hits), F.col("big") & (F.col("digest") == F.col("hit_digest")), "left")
    else:
        # (id, digest) rows meet their first id without the html
        hits = (
            met(key.filter("big").select("page_id", "digest"), firsts, ["digest"], "n")
            .groupBy("page_id", "digest").agg(F.first("first_id").alias("first_id"))
            .withColumnRenamed("page_id", "hit_id").withColumnRenamed("digest", "hit_digest")
        )
        marked = key.join(hits, F.col("page_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left")
    revisit = F.col("hit_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    records = marked.select(
        "page_id", "url", "html",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )
    return materialize(records.mapInArrow(_pack, "archive string, n_records long, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of every record, verified."""
    ship(archives.sparkSession)
    return archives.select("data").mapInArrow(
        _unpack,
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary",
    )


def read_files(spark, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files under a path."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))


def op7_warc(pages: DataFrame) -> DataFrame:
    back = read_archives(write_archives(pages))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
