"""Converter of legacy (ARC) archives to WARC, with deduplicated payloads.

An ARC file starts with a ``filedesc`` record whose second line gives the
version; a record is one header line, whose fields depend on that version,
and as many bytes as its last field declares.  Each record becomes a WARC/1.1
record with an identifier, date, type and digests synthesised from the ARC
fields and the payload.  Of records with the same payload one is ``response``
and the others are ``revisit`` records without a body that refer to it.

WARC files are written by Spark's text writer: a record's closing CRLF pair is
the line separator, so each part file is a plain (gzipped) WARC file.  They
are read back as whole files, of bounded expected size, by declared lengths.

Defined cases: a null html is the empty payload; a null url is
``about:blank``; a null page_id stays null; white space in an url is
percent-encoded; repeated rows keep a record each, of the same type; an empty
table gives no archive and an empty result; further columns are ignored.
Pages have no date of their own, so their records have NO_DATE; converted ARC
files keep each record's date and address.

Archives of other writers are read too: field names in any case, continued
lines, records without a payload digest (it is computed) or with one of
another form (it isn't compared); records without a payload of their own, such
as warcinfo and request, are passed over; lengths that are missing or no
numbers are an ArchiveError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, partitions

#: Expected bytes of one archive file before compression.
ARCHIVE_BYTES = 24 << 20
#: Date of records whose source has none.
NO_DATE = "20000101000000"

# fixed values: field names of the header lines of both versions
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
FIELD_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArchiveError(ValueError):
    """An archive that doesn't follow its declared form."""


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: int
    block: bytes


def arc_bytes(version: int, records: list[tuple[str, str, str, bytes]], name: str = "pages.arc") -> bytes:
    """An ARC file of (url, date, mime, block) records."""
    about = f"{version} {0 if version == 1 else 1} stateloom\n{FIELD_LINES[version]}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "0.0.0.0", NO_DATE, "text/plain", len(about), name), about, b"\n"]
    for url, date, mime, block in records:
        out += [_arc_line(version, url, "0.0.0.0", date, mime, len(block), name), block, b"\n"]
    return b"".join(out)


def _arc_line(version: int, url: str, ip: str, date: str, mime: str, length: int, name: str) -> bytes:
    values = {"url": url, "ip": ip, "date": date, "mime": mime, "status": "200", "checksum": "-", "location": "-", "offset": "0", "filename": name, "length": str(length)}
    return (" ".join(values[f] for f in FIELDS[version]) + "\n").encode()


def _header_text(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _length(text: str | None, at: int) -> int:
    if text is None or not re.fullmatch(r"[0-9]+", text.strip()):
        raise ArchiveError(f"no length at byte {at}: {text!r}")
    return int(text)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its ``filedesc`` record."""
    version, at = None, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no end of the header line at byte {at}")
        words = _header_text(data[at:end]).rstrip("\r").split(" ")
        # the first header line is read before the version is known: its length comes last in both
        names = FIELDS[version] if version else None
        if names is not None and len(words) != len(names):
            raise ArchiveError(f"{len(words)} fields at byte {at}; version {version} has {len(names)}")
        length = _length(words[-1], at)
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ArchiveError(f"{length} bytes declared at byte {at}, {len(block)} present")
        at = end + 1 + length
        if version is None:
            if not words[0].startswith("filedesc://"):
                raise ArchiveError("an archive starts with a filedesc record")
            first = block.split(b" ", 1)[0]
            if first not in (b"1", b"2"):
                raise ArchiveError(f"version {first[:20]!r}")
            version = int(first)
            continue
        field = dict(zip(names, words, strict=True))
        # a result code that is none, as "-", is no HTTP status
        status = field.get("status", "200")
        yield ArcRecord(field["url"], field["ip"], field["date"], field["mime"], int(status) if status.isdigit() else 0, block)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head + found, payload) if found and head.startswith(b"HTTP/") else (b"", block)


def _warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, key: str, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record without its closing CRLF pair; ``key`` makes the identifier.

    refers_to: key and digest of the record with the same payload, for a revisit.
    """
    head, payload = _split_http(record.block)
    digest = base32_sha1(payload)
    kind = "resource" if not head else "revisit" if refers_to else "response"
    block = head if kind == "revisit" else record.block
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_uuid(record.url, key, digest)),
        ("WARC-Date", _warc_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response" if head else record.mime),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", refers_to[0]),
            ("X-Refers-To-Key", refers_to[1]),
            ("X-Payload-Length", str(len(payload))),
        ]
    fields += [("X-Source-Key", key), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


#: Field names as this writer spells them, by their lower case.
_NAMES = {
    n.lower(): n
    for n in (
        "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Payload-Digest", "WARC-Block-Digest",
        "Content-Type", "WARC-Profile", "WARC-Refers-To", "X-Refers-To-Key", "X-Payload-Length", "X-Source-Key", "Content-Length",
    )
}
#: Records that stand for a resource.
PAYLOAD_TYPES = ("response", "resource", "revisit")


def _fields(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
            continue
        left, found, right = line.partition(":")
        if not found:
            raise ArchiveError(f"no field: {line[:80]!r}")
        name = _NAMES.get(left.strip().lower(), left.strip())
        out[name] = right.strip()
    return out


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = _header_text(data[at : max(end, at)]).split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ArchiveError(f"no record at byte {at}")
        fields = _fields(lines[1:])
        length = _length(fields.get("Content-Length"), at)
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ArchiveError(f"{length} bytes declared at byte {at}, {len(block)} present")
        yield fields, block
        at = end + 4 + length


def _clean_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def _http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (key, url, html, first) by way of ARC archives of both versions to WARC records."""
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            rows = batch.slice(start, 128).to_pylist()
            out: list[str | None] = [None] * len(rows)
            for version in (1, 2):
                chosen = [i for i in range(len(rows)) if i % 2 == version - 1]
                made = arc_bytes(version, [(_clean_url(rows[i]["url"]), NO_DATE, "text/html", _http_block((rows[i]["html"] or "").encode())) for i in chosen])
                for i, record in zip(chosen, read_arc(made), strict=True):
                    first = rows[i]["first"]
                    refers = None
                    if first is not None:
                        refers = record_uuid(_clean_url(rows[i]["first_url"]), first, base32_sha1(_split_http(record.block)[1])), first
                    out[i] = to_warc(record, rows[i]["key"], refers).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for batch in batches:
        for content in batch.column(0):
            rows: dict[str, list] = {"key": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "first": []}
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            for fields, block in read_warc(data):
                kind = fields.get("WARC-Type")
                if kind not in PAYLOAD_TYPES:
                    continue
                _, payload = _split_http(block)
                stated = fields.get("WARC-Payload-Digest", "")
                digest = stated[5:].upper() if stated[:5].lower() == "sha1:" else None
                if kind == "revisit":
                    # its payload is elsewhere; of other writers' revisits the length isn't known
                    length = int(fields["X-Payload-Length"]) if fields.get("X-Payload-Length", "").isdigit() else None
                else:
                    # archived HTTP headers may lack the payload's length or state another
                    length, made = len(payload), base32_sha1(payload)
                    if digest is not None and len(digest) == len(made) and digest != made:
                        raise ArchiveError(f"payload of {fields.get('WARC-Record-ID')} differs from its digest")
                    digest = made
                rows["key"].append(fields.get("X-Source-Key"))
                rows["payload_bytes"].append(length)
                rows["payload_digest"].append(digest)
                rows["record_type"].append(kind)
                rows["first"].append(fields.get("X-Refers-To-Key"))
            yield pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.string()), pa.array(rows["payload_bytes"], pa.int64()), *(pa.array(rows[c], pa.string()) for c in ("payload_digest", "record_type", "first"))], names=list(rows))


def read_warc_files(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("content").mapInArrow(_read_back, "key string, payload_bytes long, payload_digest string, record_type string, first string")
    number = lambda c: F.col(c).try_cast("long")  # noqa: E731  other keys than ids of pages give null
    return rows.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a WARC record for each row of pages (page_id, url, html) to a folder of archives.

    Payloads of fewer than ``least_bytes`` bytes are never revisits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("-")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # roles are decided on (id, digest) rows; only a join on the id, even for hot payloads, moves the texts
    light = rows.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = light.groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min(F.struct("page_id", "key", "url")).alias("f"))
    roles = light.join(firsts, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))).where(F.col("page_id") != F.col("f.page_id"))
    roles = roles.select(F.col("key").alias("k"), F.col("digest").alias("rd"), F.col("f.key").alias("first"), F.col("f.url").alias("first_url")).distinct()
    # dealt to as many tasks as archives, by the join's keys, so that the join moves the roles alone
    files = max(partitions(pages.sparkSession), -(-int(total) // ARCHIVE_BYTES))
    dealt = rows.select("key", "digest", "url", "html").repartition(files, "key", "digest")
    joined = dealt.join(roles, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("rd")), "left")
    joined.select("key", "url", "html", "first", "first_url").mapInArrow(_convert, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def archive_pages(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages' archives and read them back."""
    path = path or Scratch(pages.sparkSession, "warc").path("archives")
    write_warc(pages, path, least_bytes)
    return read_warc_files(pages.sparkSession, path)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ARC files (path, content), one at a time."""
    import gzip

    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py()
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
            for n, record in enumerate(read_arc(data)):
                head, payload = _split_http(record.block)
                row = {"key": f"{name.rpartition('/')[2]}#{n}", "file": name, "n": n, "http": bool(head), "digest": base32_sha1(payload), "size": len(payload)}
                row |= {"url": record.url, "ip": record.ip, "date": record.date, "mime": record.mime, "status": record.status, "block": record.block}
                yield pa.RecordBatch.from_pylist([row], pa.schema(_RECORD_TYPES))


_RECORD = "key string, file string, n long, http boolean, digest string, size long, url string, ip string, date string, mime string, status int, block binary"
_RECORD_TYPES = [("key", pa.string()), ("file", pa.string()), ("n", pa.int64()), ("http", pa.bool_()), ("digest", pa.string()), ("size", pa.int64()), *((c, pa.string()) for c in ("url", "ip", "date", "mime")), ("status", pa.int32()), ("block", pa.binary())]


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(batch.num_rows):
            (r,) = batch.slice(start, 1).to_pylist()
            refers = (record_uuid(r["first_url"], r["first"], r["digest"]), r["first"]) if r["first"] is not None else None
            made = to_warc(ArcRecord(r["url"], r["ip"], r["date"], r["mime"], r["status"], r["block"]), r["key"], refers)
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["value"])


def convert_arc_files(spark, source: str, target: str) -> None:
    """Convert a folder of ARC files, plain or gzipped, to WARC files.

    Records of any media type keep their bytes.  Of the HTTP responses with the
    same payload, not empty, the first by date, file and place is a response
    and the others are revisits; records without an HTTP header are resources.
    A header line that isn't UTF-8 is read as Latin-1.  Each ARC file is read
    whole by one task, so it may have at most 2 GB.
    """
    scratch = Scratch(spark, "arc")
    files = spark.read.format("binaryFile").load(source).select("path", "content")
    records = scratch.keep(files.mapInArrow(_records, _RECORD), "records")
    # roles are decided on rows without the blocks, and joined by file and place
    light = records.where("http and size > 0").select("digest", "size", "date", "file", "n", "key", "url")
    firsts = light.groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min(F.struct("date", "file", "n", "key", "url")).alias("f"))
    roles = light.join(firsts, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))).where((F.col("file") != F.col("f.file")) | (F.col("n") != F.col("f.n")))
    roles = roles.select("file", "n", F.col("f.key").alias("first"), F.col("f.url").alias("first_url"))
    made = records.join(roles, ["file", "n"], "left").select("key", "url", "ip", "date", "mime", "status", "digest", "block", "first", "first_url").mapInArrow(_converted, "value binary")
    # Spark's text writer writes a string's bytes as they are, and commits files by rename
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(target)
