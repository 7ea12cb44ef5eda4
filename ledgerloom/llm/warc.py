"""WARC archives: writer with revisit records and a salvage reader.

Every record is a gzip member of its own.  `write_archives` lets Spark's text writer put the members
into files, so that a task that is run again never leaves a half file behind; the writer's separator
between rows is an empty gzip member.  Records with equal payloads are written once, as the
`response` of the largest page_id; the others are `revisit` records that name it.

`salvage` reads an archive, plain or compressed.  A record counts if its member's checksum, version
line, lengths, closing line ends and block digest are right.  After a failed check the reader looks
for the next member or version line at which a right record starts, goes on there, and logs the bytes
between as a quarantined gap with the reason.

Defined results: null html is an empty payload; a null url is written as about:blank; a null page_id
is written as an empty number and read back as null, it is smaller than any number; rows equal in
page_id and payload are each written in full; an empty table gives an archive without records;
further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialize, shared_dir

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
# Fixed value: profile of a revisit by equal payload, as in the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"
_PLACE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
LEVEL = 4
SCHEMA = ("archive string, kind string, start long, end long, reason string, page_id long, url string, record_type string, "
          "refers_to long, payload_bytes long, payload_digest string, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, keeper: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the payload's length and digest, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
             "WARC-Target-URI: " + (quote(url, safe="/:?#[]@!$&'()*+,;=%-._~") if url else "about:blank"),
             f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(keeper)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> None:
    """Archives of all pages in folder, a gzip member per record."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("digest"))
    facts = materialize(rows.select("page_id", "digest").distinct(), "payloads")
    keepers = facts.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    marks = facts.join(keepers, "digest").select(F.col("page_id").alias("id"), F.col("digest").alias("sum"), "keeper")
    rows = rows.join(marks, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sum"))).select(
        "page_id", "url", "payload", "digest", "keeper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                page, url, payload, digest, keeper = (c[i].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(member(record(page, url, payload, len(payload), digest, keeper, page != keeper)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", member(b"").decode("latin-1")).text(folder)


def _number(name: str) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", name)
    return int(found[1]) if found else None


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at a version line, its end and, if it is wrong, the reason."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "header without end"
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without colon"
        key = key.strip().lower().decode("latin-1")
        if key in fields and key != "warc-concurrent-to":
            return None, at, "header field stands twice"
        fields[key] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        return None, at, "no content length"
    begin = head + 4
    end = begin + int(fields["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        return None, at, "record cut or wrong length"
    block = data[begin:end]
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{base32_sha1(block)}":
        return None, at, "block digest differs"
    return fields | {"block": block}, end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    unpack = zlib.decompressobj(31)
    try:
        text = unpack.decompress(data[at:] if at else data)
    except zlib.error:
        return None, at
    return (text, len(data) - len(unpack.unused_data)) if unpack.eof else (None, at)


def _good(data: bytes, at: int) -> tuple[list[dict], int, str]:
    """Records of the member or the plain record at a place, its end, and the reason if it is not right."""
    if not data.startswith(_MAGIC, at):
        found, end, why = parse_record(data, at)
        return [found] if found else [], end, why
    # Members are unpacked from growing pieces, so that a member costs its own length only.
    size = 1 << 16
    while True:
        piece = data[at:at + size]
        text, used = _member(piece, 0)
        if text is not None or at + size >= len(data):
            break
        try:
            zlib.decompressobj(31).decompress(piece)
        except zlib.error:
            break
        size *= 4
    if text is None:
        return [], at, "gzip member is damaged"
    records, place = [], 0
    while place < len(text):
        found, place, why = parse_record(text, place)
        if found is None:
            return [], at, why
        records.append(found)
    return records, at + used, ""


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, fields) and ("gap", start, end, reason), in the order of the archive."""
    at, lost, why = 0, None, ""
    while at < len(data):
        records, end, reason = _good(data, at)
        if end > at:
            if lost is not None:
                yield "gap", lost, at, why
                lost = None
            for found in records:
                yield "record", at, end, found
            at = end
            continue
        if lost is None:
            lost, why = at, reason
        place = _PLACE.search(data, at + 1)
        at = place.start() if place else len(data)
    if lost is not None:
        yield "gap", lost, len(data), why


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per recovered record and per quarantined gap of the archives in folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for kind, start, end, found in salvage(data):
                    rows.append(row(path, kind, start, end, found))
                    held += len(rows[-1]["payload"] or b"")
                    if held > 16 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def row(path, kind, start, end, found):
        out = dict.fromkeys(schema.names) | {"archive": path, "kind": kind, "start": start, "end": end}
        if kind == "gap":
            return out | {"reason": found}
        head, _, payload = found["block"].partition(b"\r\n\r\n")
        revisit = found.get("warc-type") == "revisit"
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
        return out | {
            "page_id": _number(found.get("warc-record-id", "")), "url": found.get("warc-target-uri"), "record_type": found.get("warc-type"),
            "refers_to": _number(found.get("warc-refers-to", "")) if revisit else None,
            "payload_bytes": int(length[1]) if revisit and length else len(payload),
            "payload_digest": found.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload),
            "payload": payload if with_payload and not revisit else None}

    schema = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
                        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
