"""WARC archives: one gzip member for each record, written and read in order.

write() gives every page a record whose block is an HTTP response. Pages with
equal payloads (by SHA-256) of at least MIN_SHARED bytes share one: that of the
smallest page_id is the response, the others become revisit records of the
identical-payload-digest profile, which hold the HTTP head only. Each Spark task
writes archives of bounded size into the shared folder; the manifest, a row an
archive, is a table, so files of attempts that were lost are never read.

read() takes an archive a task: the gzip members one after the other, inflated
in pieces, framed by Content-Length, block and payload digests recomputed. A
damaged archive raises ArchiveError with the place of the record.

Defined results: a null html is an empty payload; an empty table gives no
archives and no rows; rows that repeat a page_id each get a record, and all rows
that carry the smallest page_id of a payload are responses; a null page_id counts
as larger than any other, and where equal payloads have no other all are
responses; a null or empty url is written as urn:page; characters that a header
can't hold are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, open_shared, shared_dir, small, table

#: Payloads of fewer bytes are always written whole.
MIN_SHARED = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Date of all records, as the pages carry none.
DATE = "2025-09-01T00:00:00Z"
LEVEL = 6
#: Bytes read, and inflated, at once; bytes that the head of a record may take.
PIECE, MAX_HEAD = 1 << 18, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
PRINTABLE = "".join(map(chr, range(33, 127)))


class ArchiveError(ValueError):
    """An archive that breaks the format or doesn't hold what its digests say."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def member(fields: list[tuple[str, object]], block: bytes, level: int = LEVEL) -> bytes:
    """A record as a gzip member."""
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((z.compress(head.encode()), z.compress(block), z.compress(END), z.flush()))


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = LEVEL) -> bytes:
    """The record of a page: a response, or with refers_to a revisit of that page's response."""
    own = [] if page_id is None else [("Page-ID", page_id)]
    kind = [("WARC-Type", "response")] if refers_to is None else [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", refers_to)]
    fields = [
        *kind, *own, ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "urn:page", safe=PRINTABLE)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return member(fields, head + payload if refers_to is None else head, level)


class Inflater:
    """The gzip members of a stream, one after the other, inflated a piece at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.have, self.z = stream, b"", b"", None

    def open_next(self) -> bool:
        """Starts the next member; False at the end of the stream."""
        self.raw = self.raw or self.stream.read(PIECE)
        self.z, self.have = zlib.decompressobj(31), b""
        return bool(self.raw)

    def piece(self) -> bytes:
        """Bytes of this member, in order; none at its end."""
        if self.have:
            out, self.have = self.have, b""
            return out
        while not self.z.eof:
            self.raw = self.raw or self.stream.read(PIECE)
            ended = not self.raw
            try:
                out = self.z.decompress(self.raw, PIECE)
            except zlib.error as e:
                raise ArchiveError(f"not a gzip member: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out
            if ended:
                raise ArchiveError("the archive ends within a member")
        return b""

    def head(self) -> list[str]:
        """The lines up to the next empty one."""
        got = b""
        while (at := got.find(END)) < 0:
            more = self.piece()
            if not more or len(got) > MAX_HEAD:
                raise ArchiveError("a head without end")
            got += more
        self.have = got[at + len(END) :]
        return got[:at].decode("utf-8", "replace").split("\r\n")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            out = self.piece()
            if not out:
                raise ArchiveError(f"{n} bytes fewer than Content-Length says")
            out, self.have = out[:n], out[n:]
            n -= len(out)
            yield out


def fields_of(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


def number(fields: dict[str, str], name: str) -> int:
    try:
        return int(fields[name])
    except (KeyError, ValueError):
        raise ArchiveError(f"no number in {name}") from None


def http_payload(pieces: Iterator[bytes], whole) -> Iterator[dict[str, str] | bytes]:
    """The fields of an HTTP head, then the payload in pieces. whole: takes in every piece as it comes."""
    got, fields = b"", None
    for piece in pieces:
        whole.update(piece)
        if fields is not None:
            yield piece
            continue
        got += piece
        if (at := got.find(END)) >= 0:
            fields = fields_of(got[:at].decode("latin-1").split("\r\n")[1:])
            yield fields
            yield got[at + len(END) :]
        elif len(got) > MAX_HEAD:
            raise ArchiveError("an HTTP head without end")
    if fields is None:
        raise ArchiveError("no HTTP head")


def records(stream, payloads: bool = False) -> Iterator[tuple[int | None, int, str, str, int | None, bytes | None]]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and (if payloads) the payload of every page's record, verified."""
    source, n = Inflater(stream), 0
    while source.open_next():
        n += 1
        try:
            version, *lines = source.head()
            fields = fields_of(lines)
            if not version.startswith("WARC/1."):
                raise ArchiveError(f"version {version[:20]!r}")
            kind, length, block = fields.get("warc-type"), number(fields, "content-length"), hashlib.sha256()
            row = None
            if kind in ("response", "revisit"):
                parts = http_payload(source.take(length), block)
                http, digest, size, kept = next(parts), hashlib.sha256(), 0, []
                for piece in parts:
                    digest.update(piece)
                    size += len(piece)
                    if payloads:
                        kept.append(piece)
                said = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                if kind == "revisit" and size:
                    raise ArchiveError("a revisit with a payload")
                if kind == "response" and (digest.hexdigest() != said or size != number(http, "content-length")):
                    raise ArchiveError("the payload isn't what its digest or length says")
                row = (number(fields, "page-id") if "page-id" in fields else None, number(http, "content-length"), said, kind, number(fields, "refers-to-page-id") if kind == "revisit" else None, b"".join(kept) if payloads else None)
            else:
                for piece in source.take(length):
                    block.update(piece)
            if block.hexdigest() != fields.get("warc-block-digest", "").removeprefix("sha256:"):
                raise ArchiveError("the block isn't what its digest says")
            rest = b"".join(iter(source.piece, b""))
            if rest != END:
                raise ArchiveError("Content-Length isn't the block's")
        except ArchiveError as e:
            raise ArchiveError(f"record {n}: {e}") from None
        if row:
            yield row


class ArchiveWriter:
    def __init__(self, path: str, level: int):
        self.path, self.level, self.n, self.size = path, level, 0, 0
        self.out = open_shared(path, "w")
        self.put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))

    def put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.size += len(raw)

    def add(self, *page) -> None:
        self.put(page_member(*page, self.level))
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.n, self.size


def referred(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every page. Only digests that occur twice are joined, so few rows meet the pages, which move only if those are many."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    shared = own.where(F.octet_length("payload") >= min_shared).groupBy(F.unhex("digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("n"))
    shared = cut(shared.where("n > 1 and _first is not null").drop("n"), "shared-payloads")
    out = own.join(small(shared), F.unhex("digest") == F.col("_digest"), "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every page into archives in folder. Returns the manifest: path, n_records, n_bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, rows, out = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = out or ArchiveWriter(f"{folder}/{task:06d}-{len(rows):04d}-{uuid.uuid4().hex}.warc.gz", level)
                out.add(*page)
                if out.size >= archive_bytes:
                    rows.append(out.close())
                    out = None
        if out:
            rows.append(out.close())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "n_records", "n_bytes"])

    return cut(referred(pages).mapInArrow(part, "path string, n_records long, n_bytes long"), "archives")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record in the manifest's archives; with payloads, its payload too (null for a revisit)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=True)], names=names)

    def part(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_shared(path, "r") as f:
                    try:
                        for row in records(f, payloads):
                            rows.append((*row[:5], row[5] if row[3] == "response" else None))
                            size += 100 + len(row[5] or b"")
                            if size >= 8 << 20:
                                yield flush(rows)
                                rows, size = [], 0
                    except ArchiveError as e:
                        raise ArchiveError(f"{path}: {e}") from None
                if rows:
                    yield flush(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # archives are bounded, so a task for each
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(part, schema)


def unresolved(archived: DataFrame) -> DataFrame:
    """The revisits among read records that no response answers with the same digest and length."""
    response = archived.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return archived.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "pages"), folder))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
