"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader decompresses incrementally with zlib, member after member, so that it holds one record at a time whatever the
archive's size; a record's block is framed by its Content-Length, and block and payload are checked against their digests.
The payload of an HTTP message is what follows its headers, freed of chunked framing.

Archives made by Spark jobs are rows (archive, part, content) of a table: each content is a run of whole members, as in
a .warc.gz file. `export_archives` writes them out as files, each archive by the task that holds it; `read_archives` takes
such rows, and `read_archive_files` reads .warc.gz files of any size as streams that the tasks open.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remove, slices, texts_of

#: Members of one row of an archive table, in bytes before compression, about.
PART_BYTES = 4 << 20
READ_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"


#: Digest algorithms that are checked, and their sizes; other names are passed over.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class DamagedRecord(ValueError):
    pass


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")

    @property
    def http(self) -> bool:
        return self.headers.get("content-type", "").replace(" ", "").lower().startswith("application/http") and self.type in ("response", "request", "revisit")

    @property
    def body(self) -> bytes:
        """The block without an HTTP message's headers."""
        return self.block[http_end(self.block) :] if self.http else self.block

    @property
    def payload(self) -> bytes:
        """The body, freed of chunked framing where the HTTP headers name it and the framing is whole."""
        if not self.http:
            return self.block
        end = http_end(self.block)
        chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", self.block[:end])
        whole = unchunked(self.block[end:]) if chunked else None
        return self.block[end:] if whole is None else whole


def http_end(block: bytes) -> int:
    """Where an HTTP message's headers end; all of a block without an end of headers is headers."""
    found = re.search(rb"\r?\n\r?\n", block)
    return found.end() if found else len(block)


def unchunked(body: bytes) -> bytes | None:
    """What the chunks of an HTTP body hold, or None if the body is no whole run of chunks."""
    out, at = [], 0
    while True:
        line = body.find(b"\n", at)
        size = body[at:line].split(b";")[0].strip()
        if line < 0 or not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if line + 1 + n > len(body):
            return None
        out.append(body[line + 1 : line + 1 + n])
        at = line + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0


def agrees(named: str, *contents: bytes) -> bool:
    """Whether a digest `algorithm:value`, in base 32 or 16, is that of one of the contents; an unknown algorithm agrees."""
    algorithm, colon, value = named.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if not colon or algorithm not in ALGORITHMS:
        return True
    for content in contents:
        raw = hashlib.new(algorithm, content, usedforsecurity=False).digest()
        if value.strip().lower() == raw.hex() or value.strip().rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("="):
            return True
    return False


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own; the same record gives the same bytes."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _pieces(source: Iterable[bytes]) -> Iterator[bytes]:
    for x in source:
        for at in range(0, len(x), READ_BYTES):
            yield x[at : at + READ_BYTES]


def _members(source: Iterable[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Decompressed pieces, and whether each ends its member."""
    unpacker, begun = zlib.decompressobj(31), False
    for piece in _pieces(source):
        while piece:
            try:
                out = unpacker.decompress(piece, READ_BYTES * 16)
            except zlib.error as e:
                raise DamagedRecord(f"not a gzip member: {e}") from e
            begun = True
            if unpacker.eof:
                yield out, True
                piece, unpacker, begun = unpacker.unused_data, zlib.decompressobj(31), False
            else:
                yield out, False
                piece = unpacker.unconsumed_tail
    if begun:
        raise DamagedRecord("the archive ends inside a gzip member")


def read_records(source: Iterable[bytes], check: bool = True) -> Iterator[Record]:
    """Records of an archive that comes in pieces of any size. Raises DamagedRecord on bad framing or digests."""
    held = bytearray()
    headers: dict[str, str] | None = None
    length = 0
    for out, last in _members(source):
        held += out
        if headers is None and (end := held.find(b"\r\n\r\n")) >= 0:
            lines = held[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise DamagedRecord(f"no WARC version: {lines[0][:40]!r}")
            headers = {}
            for line in lines[1:]:
                name, colon, value = line.partition(":")
                if not colon:
                    raise DamagedRecord(f"no header: {line[:40]!r}")
                headers[name.strip().lower()] = value.strip()
            if not headers.get("content-length", "").isdigit():
                raise DamagedRecord("no Content-Length")
            length = int(headers["content-length"])
            del held[: end + 4]
        if last:
            if headers is None or len(held) != length + 4 or held[length:] != b"\r\n\r\n":
                raise DamagedRecord("the record's length differs from its Content-Length")
            record = Record(headers, bytes(held[:length]))
            named, payload = headers.get("warc-block-digest", ""), headers.get("warc-payload-digest", "")
            if check and not agrees(named, record.block):
                raise DamagedRecord(f"the block's digest is not {named}")
            # a revisit names the payload of another record, and segments that of the whole
            if check and payload and payload != named and record.type not in ("revisit", "continuation") and "warc-segment-number" not in headers and not agrees(payload, record.body, record.payload):
                raise DamagedRecord(f"the payload's digest is not {payload}")
            yield record
            held, headers = bytearray(), None


def uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(text: str | None) -> int | None:
    return None if text is None or text == uri(None) else int(text[len("<urn:page:") : -1])


def page_record(page_id: int | None, url: str | None, payload: bytes, named: str, refers_to: int | None, level: int = 6) -> bytes:
    """A response, or a revisit of the response of refers_to: its block is empty, its payload's digest and size are named."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    clean = "".join(c if c >= " " else " " for c in url or "").strip()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", uri(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", clean)]
    headers += [("WARC-Payload-Digest", f"sha1:{named}"), ("WARC-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{digest(block) if revisit else named}")]
    if revisit:
        headers += [("WARC-Refers-To", uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return member([*headers, ("Content-Type", "text/html; charset=utf-8")], block, level)


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive rows (archive, part, content) of the pages' records.

    Of pages with equal payloads (size and SHA-1) of at least least_bytes, the one with the smallest id is a response and
    others are revisits; smaller payloads are all responses. A null payload is empty. A null id never is the smallest;
    rows that repeat the smallest id are responses too; pages that all lack an id are responses. Other columns are
    ignored, whatever their names. No rows give no archives. Payloads are digested before any row moves; digests and ids
    alone tell which pages are revisits, and html moves by its page's id, so that no payload gathers its pages in one task.
    """
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumns({"sha1": F.unhex(F.sha1(F.encode("html", "UTF-8"))), "bytes": F.octet_length("html").cast("long")})
    # digests and ids alone tell which rows are revisits: a row for each id and payload that repeats another's
    slim = keyed.select("sha1", "bytes", "page_id").where(F.col("bytes") >= least_bytes)
    first = slim.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    again = slim.distinct().join(first, ["sha1", "bytes"]).where("NOT (page_id <=> first)").selectExpr("page_id AS p", "sha1 AS s", "bytes AS b", "first AS refers")
    dealt = keyed.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")) & (F.col("bytes") == F.col("b")), "left").select("page_id", "url", "html", "refers")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, part = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        for batch in batches:
            for rows in slices(batch, "html", PART_BYTES):
                out = bytearray()
                for page_id, url, payload, refers in zip(rows.column("page_id").to_pylist(), rows.column("url").to_pylist(), texts_of(rows.column("html")), rows.column("refers").to_pylist(), strict=True):
                    out += page_record(page_id, url, payload, digest(payload), refers, level)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([bytes(out)], pa.binary())], ["archive", "part", "content"])
                part += 1

    return scratch.write(dealt.mapInArrow(write, "archive string, part long, content binary"), "archives")


RECORDS = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _schema() -> pa.Schema:
    return pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in RECORDS.split(", "))])


def _record_rows(source: Iterable[bytes], check: bool, payloads: bool) -> Iterator[pa.RecordBatch]:
    """Rows of an archive's records, some megabytes at a time."""
    schema = _schema()
    rows: list[tuple] = []
    held = 0
    for r in read_records(source, check):
        h = r.headers
        revisit = r.type == "revisit"
        payload = b"" if revisit else r.payload
        named = h.get("warc-payload-digest") or (None if r.type != "response" else f"sha1:{digest(payload)}")
        rows.append((r.type, h.get("warc-record-id"), h.get("warc-target-uri"), named and named.removeprefix("sha1:"), int(h.get("warc-payload-length", len(payload))) if revisit else len(payload), h.get("warc-refers-to"), None if revisit or not payloads else payload))
        held += len(payload) if payloads else 200
        if held > PART_BYTES:
            yield _rows(rows, schema)
            rows, held = [], 0
    if rows:
        yield _rows(rows, schema)


def read_archives(archives: DataFrame, check: bool = True, payloads: bool = True) -> DataFrame:
    """The records of the rows' `content`, each a whole number of gzip members; the payload of a revisit is null.

    A null or empty content has no records; repeated rows are read each. Other columns are ignored, whatever their names. A
    damaged record raises.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                yield from _record_rows([memoryview(content.as_buffer())] if content.is_valid else [], check, payloads)

    return archives.select("content").mapInArrow(read, RECORDS)


def _opened(path: str):
    """The file system and the path in it, as pyarrow knows them."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _pieces_of(path: str) -> Iterator[bytes]:
    where, at = _opened(path)
    with where.open_input_stream(at, compression=None) as stream:
        while piece := stream.read(READ_BYTES * 16):
            yield piece


def read_archive_files(spark: SparkSession, path: str, check: bool = True, payloads: bool = True) -> DataFrame:
    """The records of .warc.gz files below a folder or glob. Each file is a stream that its task opens and never holds whole.

    Spark lists the files (their contents are not read by it); tasks open them by pyarrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path).select("path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("path").to_pylist():
                yield from _record_rows(_pieces_of(one), check, payloads)

    return files.mapInArrow(read, RECORDS)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def export_archives(archives: DataFrame, folder: str) -> int:
    """Writes archive rows as .warc.gz files below the folder, which all executors share, and returns how many.

    The task that holds an archive's rows writes its file, under a name of its own, and renames it when it is whole, so that
    a task that is lost or run twice leaves no half of an archive. Nothing but the files' names goes to the driver.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _opened(folder)
        where.create_dir(root, recursive=True)
        name, held, out = None, "", None

        def close() -> pa.RecordBatch:
            out.close()
            where.move(held, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])

        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                if archive != name:
                    if out is not None:
                        yield close()
                    name, held = archive, f"{root}/_{uuid.uuid4().hex}"
                    out = where.open_output_stream(held, compression=None)
                out.write(content.as_buffer())
        if out is not None:
            yield close()

    dealt = archives.select("archive", "part", "content").repartition("archive").sortWithinPartitions("archive", "part")
    return dealt.mapInArrow(write, "archive string").distinct().count()


def pages_from_archives(records: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = "CASE WHEN {0} LIKE '<urn:page:%' AND {0} <> '<urn:page:none>' THEN CAST(substring({0}, 11, length({0}) - 11) AS BIGINT) END"
    return records.selectExpr(number.format("record_id") + " AS page_id", "payload_bytes", "payload_digest", "record_type", number.format("refers_to") + " AS refers_to")


__all__ = ["DamagedRecord", "Record", "digest", "export_archives", "member", "page_of", "page_record", "pages_from_archives", "read_archive_files", "read_archives", "read_records", "remove", "uri", "write_archives"]
