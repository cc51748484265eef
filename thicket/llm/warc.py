"""WARC archives: a deduplicating writer and a reader that salvages damaged archives.

An archive is one value of a binary column (a row of a table of archives, or the content
of a file read with the binaryFile source), so archives lie in whatever store Spark reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import written

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d+)>")
#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 4 << 20
#: Members within members that are followed; of archives from elsewhere, bytes that one member may inflate to and a header may have.
MOST_DEPTH, MOST_INFLATED, MOST_HEADER = 8, 1 << 29, 1 << 20


class Bounds(NamedTuple):
    """What a record is read within; None: whatever it takes."""

    inflated: int | None = None
    header: int | None = None


def foreign() -> Bounds:
    return Bounds(MOST_INFLATED, MOST_HEADER)


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def make_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z", compress: bool = True) -> bytes:
    """One record: an HTTP response with the payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:sha1:{sha1_base32(block)}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _plain_record(data, pos: int, bounds: Bounds) -> Record | str:
    """The uncompressed record at pos, or why there is none."""
    m = _VERSION.match(data, pos)
    if not m:
        return "no version line"
    close = data.find(b"\r\n\r\n", m.end() - 2, len(data) if bounds.header is None else m.end() + bounds.header)
    if close < 0:
        return "header without end"
    headers: dict[str, str] = {}
    last = None
    for line in data[m.end() : close].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            return "malformed header line"
        last = name.strip().lower()
        headers[last] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or not size.isascii():
        return "no content length"
    start, end = close + 4, close + 4 + int(size)
    if end > len(data):
        return "truncated block"
    if data[end : end + 4] != b"\r\n\r\n":
        return "block not followed by two line ends"
    block = data[start:end]
    algorithm, _, digest = headers.get("warc-block-digest", "").partition(":")
    if algorithm.lower() == "sha1" and digest.upper() != sha1_base32(block):
        return "block digest differs"
    return Record(pos, end + 4, headers, block)


def _member(data: bytes, pos: int, bounds: Bounds) -> tuple[bytes, int] | str:
    """The gzip member at pos and where it ends; zlib checks its length and CRC."""
    z = zlib.decompressobj(31)
    out, size, at, step = [], 0, pos, 1 << 16
    try:
        while not z.eof:
            if at >= len(data) and not z.unconsumed_tail:
                return "truncated member"
            more = z.unconsumed_tail or data[at : at + step]
            at += 0 if z.unconsumed_tail else step
            out.append(z.decompress(more, 1 << 20))
            size += len(out[-1])
            if bounds.inflated is not None and size > bounds.inflated:
                return f"member inflates to over {bounds.inflated} bytes"
    except zlib.error as e:
        return f"bad member: {e}"
    return b"".join(out), min(at, len(data)) - len(z.unused_data)


def _at(data: bytes, pos: int, depth: int, bounds: Bounds) -> tuple[list[Record | Gap], int] | str:
    """What stands at pos and where it ends, or why nothing valid does."""
    if data[pos : pos + 3] == b"\x1f\x8b\x08":
        if depth >= MOST_DEPTH:
            return f"over {MOST_DEPTH} members within each other"
        got = _member(data, pos, bounds)
        if isinstance(got, str):
            return got
        inner = list(salvage(got[0], depth + 1, bounds))
        if not any(isinstance(x, Record) for x in inner):
            return inner[0].reason if inner else "empty member"
        return [x._replace(start=pos, end=got[1]) for x in inner], got[1]
    got = _plain_record(data, pos, bounds)
    return got if isinstance(got, str) else ([got], got.end)


def salvage(data: bytes, depth: int = 0, bounds: Bounds | None = None) -> Iterator[Record | Gap]:
    """All valid records of an archive, and the byte gaps between them.

    Records are gzip members or plain.  Where a check fails (gzip's own, the header's form,
    the block's length, end or digest), the next member or version line that holds a valid
    record is searched for, and the bytes before it are a gap with the first failure's
    reason.  Gaps and records together cover the archive; within a member of several records
    a gap has the member's place.  Members within members are followed MOST_DEPTH deep.  What
    exceeds ``bounds`` (by default those for archives from elsewhere, MOST_INFLATED and
    MOST_HEADER) is a gap like other damage.
    """
    bounds = bounds or foreign()
    pos, bad, reason = 0, None, ""
    while pos < len(data):
        got = _at(data, pos, depth, bounds)
        if isinstance(got, str):
            if bad is None:
                bad, reason = pos, got
            m = _CANDIDATE.search(data, pos + 1)
            pos = m.start() if m else len(data)
            continue
        if bad is not None:
            yield Gap(bad, pos, reason)
            bad = None
        yield from got[0]
        pos = got[1]
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _archives(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    made, buffer, size = 0, [], 0

    def close():
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{made:06d}.warc.gz"]), pa.array([b"".join(buffer)], pa.binary())], names=["archive", "content"])

    for b in batches:
        for page_id, url, html, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "first")), strict=True):
            page_id, first = page_id.as_py(), first.as_py()
            again = page_id is not None and first is not None and first != page_id
            raw = make_record("revisit" if again else "response", page_id, url.as_py(), (html.as_py() or "").encode(), first if again else None)
            buffer.append(raw)
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield close()
                made, buffer, size = made + 1, [], 0
    if buffer:
        yield close()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """(archive, content): the pages as gzip-compressed WARC archives of about ARCHIVE_BYTES.

    Each row becomes one record with the html in UTF-8 as payload (null: empty).  Of equal
    payloads of at least ``revisit_from`` bytes, the row of the smallest id is a response and
    rows of other ids are revisits of it; smaller payloads are all responses.  A null id is
    a response that none refers to; rows that repeat an id with an equal payload are written
    alike.  Other columns don't matter; an empty table gives no archives.

    Payloads are told apart by SHA-256; the smallest id of each is an aggregation that
    combines on the map side, and its join back is a plain equi-join that AQE can split at
    hot payloads.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    first = rows.groupBy(F.col("key").alias("k"), F.octet_length("html").alias("size")).agg(F.min("page_id").alias("first")).filter(F.col("size") >= revisit_from)
    return rows.join(first.select("k", "first"), F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "first").mapInArrow(_archives, "archive string, content binary")


_READ = "archive string, start long, end long, gap string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def _read(batches, with_payload: bool, bounds: Bounds | None):
    names = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * with_payload
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    number = lambda s: int(m[1]) if (m := _ID.fullmatch(s)) else None
    for b in batches:
        for archive, content in zip(b.column("archive").to_pylist(), b.column("content"), strict=True):
            rows = []
            for x in salvage(content.as_py() or b"", 0, bounds):
                if isinstance(x, Gap):
                    rows.append((archive, x.start, x.end, x.reason, *[None] * 7))
                    continue
                h = x.headers
                kind, payload = h.get("warc-type"), x.block
                if "application/http" in h.get("content-type", ""):
                    payload = x.block.partition(b"\r\n\r\n")[2]
                if kind == "revisit":
                    size, digest = h.get("warc-payload-length", ""), h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = int(size) if size.isdigit() else None
                else:
                    size, digest = len(payload), sha1_base32(payload)
                rows.append((archive, x.start, x.end, None, kind, number(h.get("warc-record-id", "")), h.get("warc-target-uri"), size, digest, number(h.get("warc-refers-to", "")), payload))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names=names)


def read_archives(archives: DataFrame, archive_col: str = "archive", content_col: str = "content", with_payload: bool = False, bounds: Bounds | None = None) -> DataFrame:
    """Records and gaps of archives: archive, start, end, then gap (why these bytes are in
    quarantine) or record_type, page_id, url, payload_bytes, payload_digest, refers_to (and payload).

    payload_bytes and payload_digest of a revisit are those of the full payload, as its
    header has them.  A null or empty archive gives no rows.  ``bounds`` are those of ``salvage``.
    """
    plain = archives.select(F.col(f"`{archive_col}`").cast("string").alias("archive"), F.col(f"`{content_col}`").alias("content"))
    return plain.mapInArrow(lambda it: _read(it, with_payload, bounds), _READ + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """The pages' records, written to a table of archives in the shared folder and read back.

    One record per row of pages.  A null html is an empty payload, a null url gives no target
    URI; a row with a null id is a response of page_id null.  Of equal payloads of several
    ids the smallest id is the response; rows that repeat an id with an equal payload are all
    responses, as one with another payload is.  An empty table gives no rows; other columns
    of pages, whatever their names, don't matter.  Payloads come back whole, whatever their
    size (a value of Spark holds 2 GB): one's own archives are read without bounds, and a gap
    in them, which would be a row that is lost, is an error.
    """
    back = read_archives(written(write_archives(pages, revisit_from=revisit_from)), bounds=Bounds())
    lost = F.raise_error(F.concat(F.lit("a record doesn't come back from "), "archive", F.lit(": "), "gap"))
    return back.filter(F.when(F.col("gap").isNotNull(), lost.cast("boolean")).otherwise(F.lit(True)))


def spoil(raw: bytearray, start: int, end: int) -> None:
    """Turns over one byte amid a record's bytes, so that no record is read from them any more.

    Bytes whose turning changes nothing that a reader sees are passed over: deflate can say the
    same in several ways (a repeat of a text with a period may be taken from one period or two back).
    """
    middle = (start + end) // 2
    for at in (*range(middle, end), *range(start, middle)):
        raw[at] ^= 0xFF
        if not any(isinstance(x, Record) for x in salvage(bytes(raw[start:end]))):
            return
        raw[at] ^= 0xFF
    raise ValueError(f"no byte from {start} to {end} matters to the record there")


def damaged(archives: DataFrame, letters: str = "ABCDEF") -> DataFrame:
    """archives in which a byte amid each record whose payload digest begins with one of ``letters`` is turned over (see ``spoil``).

    For drills of the salvage reader: such a record's checks fail, its neighbours' don't, but
    for records of one gzip member, which stand or fall together.  A null content stays null.
    """

    def hit(batches):
        for b in batches:
            out = []
            for content in b.column("content"):
                raw = content.as_py()
                if raw is not None:
                    found = [x for x in salvage(raw) if isinstance(x, Record)]
                    raw = bytearray(raw)
                    for place in {(x.start, x.end) for x in found if x.headers.get("warc-payload-digest", "").removeprefix("sha1:")[:1] in [*letters]}:
                        spoil(raw, *place)
                    raw = bytes(raw)
                out.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("archive"), pa.array(out, pa.binary())], names=["archive", "content"])

    return archives.select("archive", "content").mapInArrow(hit, "archive string, content binary")


def salvage_drill(pages: DataFrame, letters: str = "ABCDEF") -> DataFrame:
    """Records and gaps read back from the pages' archives after damage (see ``damaged``)."""
    return read_archives(written(damaged(written(write_archives(pages)), letters)))
