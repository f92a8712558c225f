"""WARC archives written and read back, with a reader that goes on after damage.

Writing: a page becomes a record in a gzip member of its own. Of records with equal payloads the one with the
least id holds the payload, the others are revisits of it. Archives are written by Spark's own writer to any file
system it knows, members apart by one zero byte, which gzip readers skip.

Reading: each record is checked (member checksum, version line, headers, length, closing blank lines,
digests of payload, block and of the header itself, which the writer adds as an extension field). A header without its digest
must not hold a second version line, so the rest of a cut header never takes the next record's for its own. When a check fails, the reader looks for the next member or version line from which a record passes
all checks, goes on there, and reports the bytes between as a gap with the reason. Plain and compressed records
may follow each other. A member is read the same way: its records before and after damage are kept, also those before
the place where it can no longer be unpacked. Places are of the archive's bytes; a gap inside a member has the member's.

A null payload is empty. Rows that repeat an id with equal payload are both responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import send_code
from anamnesis.sources.workspace import fresh_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Bytes of payload that an Arrow batch of read records holds before it is sent.
BATCH_BYTES = 4 << 20
#: Records that a task packs at a time.
PACK_ROWS = 256
#: Records, and bytes of packed records, in one archive file at most, a single larger record aside. A task reads a file at once.
FILE_RECORDS, FILE_BYTES = 20_000, 64 << 20

_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]+\.[0-9]+\r\n")
_FIRST = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
#: Extension field at the end of a header: the digest of all of it before this line.
HEADER_DIGEST = "X-Header-Digest"
_OWN_DIGEST = re.compile(rb"\r\nX-Header-Digest: sha1:([A-Z2-7]{32})\Z")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value: what would end its line is written as a percent escape."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(page_id, url, payload: bytes, refers_to, revisit: bool, payload_digest: str | None = None) -> bytes:
    """One record; a revisit keeps the length and digest of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _line(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{payload_digest or digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = VERSION + b"\r\n" + "\r\n".join(f"{k}: {v}" for k, v in lines).encode()
    head += f"\r\n{HEADER_DIGEST}: sha1:{digest(head)}".encode()
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Damaged(ValueError):
    """Why a record failed its checks; of a member also the records that can be kept."""

    def __init__(self, reason: str, records: list | None = None) -> None:
        super().__init__(reason)
        self.records = records or []


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


@dataclass
class Gap:
    """Bytes that belong to no valid record."""

    start: int
    end: int
    reason: str


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("header line without a colon")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse_record(data: bytes, start: int) -> Record:
    """The record at ``start``; ``Damaged`` if any check fails."""
    first = _FIRST.match(data, start)
    if not first:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", first.end() - 2)
    if stop < 0:
        raise Damaged("header without an end")
    head = data[start:stop]
    own = _OWN_DIGEST.search(head)
    if own:
        if own[1].decode() != digest(head[: own.start()]):
            raise Damaged("header digest differs")
    elif _FIRST.search(head + b"\r\n", first.end() - start):
        raise Damaged("header without an end")
    headers = _headers(data[first.end() : stop])
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit() and len(size) < 16):
        raise Damaged("no content length")
    body = stop + 4
    end = body + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where its length says")
    block = data[body:end]
    record = Record(start, end + 4, headers, payload=block)
    own = headers.get("warc-block-digest", "")
    if own.startswith("sha1:") and own[5:] != digest(block):
        raise Damaged("block digest differs")
    if headers.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            record.http = _headers(block[:at].partition(b"\r\n")[2])
            record.payload = block[at + 4 :]
    own = headers.get("warc-payload-digest", "")
    if record.kind == "response" and own.startswith("sha1:") and own[5:] != digest(record.payload):
        raise Damaged("payload digest differs")
    return record


def _unpack(data: bytes, start: int) -> tuple[bytes, int, str]:
    """Text of the gzip member at ``start``, its end, and what stopped it before its end, if anything."""
    unpack = zlib.decompressobj(31)
    parts, at = [], start
    try:
        while not unpack.eof:
            piece = data[at : at + (1 << 16)]
            if not piece:
                return b"".join(parts), at, "member without an end"
            parts.append(unpack.decompress(piece))
            at += len(piece)
    except zlib.error as error:
        # What the last piece gives before the error is read byte by byte.
        again = zlib.decompressobj(31)
        if at > start:
            again.decompress(data[start:at])
        try:
            for k in range(len(piece)):
                parts.append(again.decompress(piece[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(parts), at, f"member: {error}"
    return b"".join(parts), at - len(unpack.unused_data), ""


def _member(data: bytes, start: int) -> tuple[list[Record | Gap], int]:
    """Records and gaps of the gzip member at ``start`` and its end; a gap is reported as the whole member.

    Of a member that can't be unpacked to its end, records with a good block digest can be kept. If its checksum is
    wrong and all its records are good, the damage is in a header or in the checksum, and none is kept.
    """
    text, end, reason = _unpack(data, start)
    found = list(_salvage(text, _FIRST))
    records = [r for r in found if isinstance(r, Record)]
    if reason:
        if "incorrect" in reason and "check" in reason and len(records) == len(found):
            records = []
        records = [r for r in records if r.headers.get("warc-block-digest", "").startswith("sha1:")]
    for r in found:
        r.start, r.end = start, end
    if reason:
        raise Damaged(reason, records)
    if text and not records:
        raise Damaged("member holds no record")
    return found, end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and gaps of an archive, in order; together with zero bytes of padding they cover it."""
    return _salvage(data, _START)


def _salvage(data: bytes, begin: re.Pattern) -> Iterator[Record | Gap]:
    """``begin`` is what a record may begin with: a version line, or a member as well."""
    at, lost, why = 0, None, ""
    while at < len(data):
        if lost is None and data[at] == 0:
            padding = re.compile(rb"\x00+").match(data, at).end()
            at = padding
            continue
        try:
            if begin is _START and data.startswith(b"\x1f\x8b", at):
                records, end = _member(data, at)
            else:
                record = parse_record(data, at)
                records, end = [record], record.end
        except Damaged as error:
            if lost is not None and error.records:
                yield Gap(lost, at, why)
                lost = None
            yield from error.records
            if lost is None:
                lost, why = at, str(error)
            found = begin.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield Gap(lost, at, why)
            lost = None
        yield from records
        at = end
    if lost is not None:
        yield Gap(lost, len(data), why)


# Fixed value: the alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(raw: Column) -> Column:
    """The base 32 text of a SHA-1 in hex: five hex digits are four letters."""
    letters = []
    for group in range(8):
        number = F.conv(F.substring(raw, 5 * group + 1, 5), 16, 10).cast("int")
        for k in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def _pages(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page, url, payload, hash)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.withColumn("hash", F.sha1("payload"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> None:
    """Write a record for every row of ``pages`` to archive files below ``path``.

    Payloads of at least ``min_bytes`` that occur more than once are written with the least id only.
    """
    send_code(pages.sparkSession)
    rows = _pages(pages, id_col, url_col, payload_col)
    size = F.octet_length("payload")
    first = rows.where(size >= min_bytes).groupBy("hash").agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1")
    placed = rows.join(first.select("hash", "least"), "hash", "left")
    revisit = F.coalesce(F.col("least").isNotNull() & ~F.col("page").eqNullSafe(F.col("least")) & (size >= min_bytes), F.lit(False))
    placed = placed.select("page", "url", F.when(~revisit, F.col("payload")).alias("payload"), size.cast("long").alias("size"), base32(F.col("hash")).alias("digest"), "least", revisit.alias("revisit"))

    def run(batches):
        part, size = 0, 0
        for batch in batches:
            for low in range(0, batch.num_rows, PACK_ROWS):
                columns = [c.to_pylist() for c in batch.slice(low, PACK_ROWS).columns]
                records, parts = [], []
                for page, url, payload, n, mark, least, again in zip(*columns, strict=True):
                    body = _Length(n) if again else payload
                    records.append(member(write_record(page, url, body, least, again, mark)))
                    if size and size + len(records[-1]) > FILE_BYTES:
                        part, size = part + 1, 0
                    parts.append(part)
                    size += len(records[-1]) + 1
                yield pa.record_batch([pa.array(records, pa.binary()), pa.array(parts, pa.int32())], names=["record", "part"])

    packed = placed.mapInArrow(run, "record binary, part int").select(F.col("record").cast("string").alias("value"), "part")
    # The parts of a task are files of their own.
    packed.write.partitionBy("part").option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class _Length(bytes):
    """Stands for a payload that is left out: only its length is known."""

    def __new__(cls, n: int):
        own = super().__new__(cls)
        own.n = n
        return own

    def __len__(self) -> int:
        return self.n


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``.

    (file, start, end, record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload, gap):
    ``gap`` has the reason where the row is a gap, whose other columns but the first three are null. Length and digest are of
    the whole payload, also for revisits.
    """
    send_code(spark)
    names = ["file", "start", "end", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "gap"]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def rows(file: str, data: bytes):
        for found in salvage(data):
            if isinstance(found, Gap):
                yield file, found.start, found.end, *[None] * 7, found.reason
                continue
            head, mark = found.headers, found.headers.get("warc-payload-digest", "")
            size = len(found.payload)
            if found.kind == "revisit" and found.http.get("content-length", "").isdigit():
                size = int(found.http["content-length"])
            mark = mark[5:] if mark.startswith("sha1:") else digest(found.payload)
            ids = head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to")
            yield file, found.start, found.end, found.kind, *ids, mark, size, found.payload if with_payload else None, None

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""):
                    held.append(row)
                    size += 200 + len(row[9] or b"")
                    if size > BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    def _batch(held):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    ddl = "file string, start long, end long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ddl)


def page_of(name) -> object:
    """The id in the name of a record that ``write_archives`` wrote."""
    return F.nullif(F.regexp_extract(name, r"^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def archived(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """``pages`` written as archives, to the shared folder by default, and read back; a gap in them is an error."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    found = read_archives(pages.sparkSession, path, with_payload=False)
    said = F.concat_ws(" ", F.lit("a record was not read back:"), "file", "start", "end", "gap")
    return found.where(F.when(F.col("gap").isNull(), True).otherwise(F.raise_error(said).cast("boolean")))
