"""Legacy archives: write and read ARC files, convert them to WARC, read WARC back.

An archive is a row (archive, part, content): parts of one archive in order, each a run of
whole gzip members, one member per record, so that any part can be read on its own and no
task holds more than a part. ``binaryFile`` tables of real .arc, .arc.gz, .warc and
.warc.gz files are read by the same functions.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable

#: Bytes of packed records after which a new part begins.
PART_BYTES = 4 << 20
#: Payloads below this size are never revisits.
REVISIT_BYTES = 100
#: The layouts of the two ARC versions (fixed format): one header line, fields by spaces.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD = ("url string, ip string, date string, mime string, status int, page_id long, record string, head binary, "
          "payload binary, payload_bytes long, payload_digest string, problem string")
#: What is wrong with a record whose place and bytes are known nevertheless.
LENGTH, NO_LENGTH, DAMAGED = "payload of another length", "content length is no number", "damaged record"


def _pack(data: bytes) -> bytes:
    return gzip.compress(data, 4, mtime=0)


def _members(content: bytes) -> Iterator[bytes]:
    """The records of gzip members one after the other, or the bytes themselves if not packed."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        unpack = zlib.decompressobj(31)
        data = unpack.decompress(content)
        yield data + unpack.flush()
        content = unpack.unused_data


def _block(page_id: int | None, payload: bytes, mime: str, status: int = 200) -> bytes:
    """An HTTP response as crawlers store it; the page's id rides in a header of its own."""
    head = f"HTTP/1.1 {status} OK\r\nContent-Type: {mime}\r\nContent-Length: {len(payload)}\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    return head.encode() + b"\r\n" + payload


def _http(block: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields by lower-case name, status and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = lines[0].split(" ")[1:2]
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
    return fields, int(status[0]) if status and status[0].isdigit() else 0, payload


def _url(url: str | None) -> str:
    """A header line's fields end at spaces, so white space in addresses is escaped."""
    text = url or ""
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in text.encode()).encode("latin-1").decode("utf-8", "replace") or "urn:none"


def arc_version_block(version: int, name: str) -> bytes:
    """The record that opens an ARC file and states the layout of the records after it."""
    body = f"{version} 0 crawler\n{' '.join(ARC_FIELDS[version])}\n\n"
    rest = ["0.0.0.0", "20000101000000", "text/plain"]
    if version == 2:
        rest += ["200", "-", "-", "0", name]
    return f"filedesc://{name} {' '.join(rest)} {len(body)}\n{body}".encode() + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, page_id: int | None, payload: bytes, mime: str = "text/html") -> bytes:
    block = _block(page_id, payload, mime)
    fields = [_url(url), "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", hashlib.md5(payload).hexdigest(), "-", str(offset), name]
    return f"{' '.join(fields)} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "20200101000000") -> DataFrame:
    """Rows (archive, part, content): the pages as ARC files, of both versions in turn.

    A file per input task. A null page is an empty payload, a null address ``urn:none``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        version, name = 1 + number % 2, f"pages-{number:06d}.arc.gz"
        part, packed, offset = 0, [_pack(arc_version_block(version, name))], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(packed)], pa.binary())], ["archive", "part", "content"])

        for batch in batches:
            for page_id, address, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if offset > PART_BYTES * (part + 1):
                    yield flush()
                    part, packed = part + 1, [_pack(arc_version_block(version, name))]
                packed.append(_pack(arc_record(version, name, offset, address, date, page_id, payload or b"")))
                offset += len(packed[-1])
        yield flush()

    source = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary"))
    return source.mapInArrow(run, "archive string, part int, content binary")


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of unpacked ARC bytes, by the layout that the version block states.

    A record whose line lacks fields, or whose bytes end before its declared length,
    comes out with a ``problem`` and ends the reading: what follows has no known place, and
    is its payload. ``head`` is the HTTP header as stored, ``record`` the identifier of a
    record without a page id.
    """
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        began = at
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        start_of_file = line[0].startswith("filedesc://")
        size = int(line[-1]) if line[-1].isdigit() else -1
        if end < 0 or size < 0 or (not start_of_file and len(line) != len(fields)) or end + 1 + size > len(data):
            rest = data[began:]
            digest = hashlib.sha256(rest).hexdigest()
            yield {"url": line[0], "date": "", "record": record_id(None, line[0], "", digest), "head": b"", "payload": rest,
                   "payload_bytes": len(rest), "payload_digest": digest, "problem": DAMAGED}
            return
        block, at = data[end + 1 : end + 1 + size], end + 1 + size
        if start_of_file:
            layout = block.split(b"\n")
            stated = tuple(layout[1].decode().split(" ")) if len(layout) > 1 else ()
            fields = stated if stated[:1] == ("URL",) else ARC_FIELDS.get(int(layout[0].split(b" ")[0] or b"1"), ARC_FIELDS[1])
            continue
        named = dict(zip(fields, line))
        head, status, payload = _http(block)
        page, stated = head.get("x-page-id", ""), head.get("content-length", str(len(payload)))
        page_id, digest = int(page) if page.lstrip("-").isdigit() else None, hashlib.sha256(payload).hexdigest()
        code = named.get("Result-code", "")
        yield {"url": named["URL"], "ip": named["IP-address"], "date": named["Archive-date"], "mime": named["Content-type"],
               "status": int(code) if code.isdigit() else status, "page_id": page_id,
               "record": record_id(None, named["URL"], warc_date(named["Archive-date"]), digest) if page_id is None else None,
               "head": block[: len(block) - len(payload)], "payload": payload, "payload_bytes": len(payload), "payload_digest": digest,
               "problem": NO_LENGTH if not stated.isdecimal() else None if int(stated) == len(payload) else LENGTH}


_TYPES = {"url": pa.string(), "ip": pa.string(), "date": pa.string(), "mime": pa.string(), "status": pa.int32(), "page_id": pa.int64(), "record": pa.string(), "head": pa.binary(),
          "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "problem": pa.string()}


def _rows(found: list[dict], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in found], t) for c, t in types.items()], list(types))


def _read(parts: DataFrame, records, types: dict[str, pa.DataType], schema: str, content: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found, size = [], 0
                for data in records(batch.column(0)[k].as_py() or b""):
                    found.append(data)
                    size += len(data.get("payload") or b"")
                    if size > PART_BYTES:
                        yield _rows(found, types)
                        found, size = [], 0
                yield _rows(found, types)

    return parts.select(content).mapInArrow(run, schema)


def read_arc(parts: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """The records of ARC parts or whole files, without payload bytes where not asked for."""

    def records(packed: bytes) -> Iterator[dict]:
        # Members of one part share the layout that its first record states.
        layout = b""
        for data in _members(packed):
            if data.startswith(b"filedesc://"):
                end = data.find(b"\n")
                size = data[:end].rsplit(b" ", 1)[-1]
                layout = data[: end + 1 + int(size)] + b"\n" if size.isdigit() else b""
                found = arc_records(data)
            else:
                found = arc_records(layout + data)
            for r in found:
                if not payloads:
                    r.pop("payload", None), r.pop("head", None)
                yield r

    return _read(parts, records, _TYPES, RECORD, content)


def warc_record(kind: str, url: str, date: str, record_id: str, block: bytes, payload_digest: str, mime: str, **more: str) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date, "WARC-Target-URI": url,
              "WARC-Payload-Digest": f"sha256:{payload_digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
              **more, "Content-Type": mime, "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    """The same identifier whenever the same record is converted."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {date} {digest} {url}"))


def warc_date(date: str) -> str:
    """A 14-digit (or shorter) ARC date as a WARC date; the epoch where it is none."""
    try:
        moment = datetime.strptime(date[:14].ljust(14, "0") if len(date) >= 8 else "", "%Y%m%d%H%M%S")
    except ValueError:
        moment = datetime.fromtimestamp(0, timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def convert(arc: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows (archive, part, content): WARC parts with a record for each record of ARC parts.

    Of records with equal payloads of at least ``min_bytes`` bytes that of the smallest
    page id is a response; others are revisits, without payload, that name it. Records
    without a page id are compared among themselves, the smallest record identifier first.
    Smaller ones, and those of another length than their header states, are responses;
    damaged ones are metadata records of their bytes. Both carry the problem on. HTTP
    headers stay as stored. Equal payloads are found on digests alone: a group of copies
    is one minimum, combined before the shuffle; its members are joined to it by page id
    or identifier, never gathered.
    """
    light = durable(read_arc(arc, payloads=False).where("problem is null").select("page_id", "record", "payload_bytes", "payload_digest"))
    big = light.where(F.col("payload_bytes") >= min_bytes).withColumn("named", F.col("page_id").isNull())
    first = big.groupBy("payload_digest", "named").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min("record").alias("first_record"), F.max("record").alias("last_record"),
    ).where("first < last or first_record < last_record").drop("last", "last_record")
    key = F.coalesce("record", F.col("page_id").cast("string")).alias("key")
    # Written first: its size is then known, and where copies are few the payloads stay in place.
    copies = durable(big.join(first, ["payload_digest", "named"]).where("page_id <> first or record <> first_record").select(
        key, "payload_digest", "first", "first_record").distinct())
    marked = read_arc(arc).select("*", key).join(copies, ["key", "payload_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        info = warc_record("warcinfo", f"urn:{name}", warc_date(""), record_id(None, name, "", ""), b"format: WARC/1.1\r\n",
                           hashlib.sha256(b"format: WARC/1.1\r\n").hexdigest(), "application/warc-fields")
        part, packed, size = 0, [_pack(info)], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(packed)], pa.binary())], ["archive", "part", "content"])

        for batch in batches:
            for page_id, url, date, head, payload, digest, problem, record, first, first_record in zip(*(c.to_pylist() for c in batch.columns)):
                stamp, more, kind, mime = warc_date(date), {} if problem is None else {"X-Problem": problem}, "response", "application/http; msgtype=response"
                block = head + payload
                if problem == DAMAGED:
                    kind, mime, url = "metadata", "application/octet-stream", _url(url)
                elif problem is None and (first is not None or first_record is not None):
                    kind, block = "revisit", head
                    more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    more |= {"WARC-Refers-To": f"<urn:uuid:{first_record}>"} if first is None else {"X-Refers-To-Page": str(first)}
                    more["X-Payload-Length"] = str(len(payload))
                packed.append(_pack(warc_record(kind, url, stamp, record or record_id(page_id, url, stamp, digest), block, digest, mime, **more)))
                size += len(packed[-1])
                if size > PART_BYTES:
                    yield flush()
                    part, packed, size = part + 1, [], 0
        if packed:
            yield flush()

    return marked.select("page_id", "url", "date", "head", "payload", "payload_digest", "problem", "record", "first", "first_record").mapInArrow(
        run, "archive string, part int, content binary")


def warc_records(data: bytes) -> Iterator[dict]:
    """The records of unpacked WARC bytes, by their declared lengths; digests are checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            if data[at:].strip():
                yield {"record_type": "damaged", "problem": "no record header"}
            return
        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = int(fields.get("content-length", "0"))
        block, at = data[end + 4 : end + 4 + size], end + 4 + size + 4
        problem = fields.get("x-problem")
        if len(block) != size or fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            problem = "block differs from its length or digest"
        kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
        out = {"record_type": kind, "record_id": fields.get("warc-record-id", ""), "url": fields.get("warc-target-uri"),
               "date": fields.get("warc-date"), "payload_digest": digest, "refers_to_record": fields.get("warc-refers-to"), "problem": problem}
        if kind == "metadata":
            out |= {"payload": block, "payload_bytes": len(block)}
        if kind in ("response", "revisit"):
            head, _, payload = _http(block)
            page, refers = head.get("x-page-id", ""), fields.get("x-refers-to-page", "")
            out |= {"page_id": int(page) if page.lstrip("-").isdigit() else None, "payload": payload,
                    "payload_bytes": int(fields.get("x-payload-length", len(payload))),
                    "refers_to": int(refers) if refers.lstrip("-").isdigit() else None}
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                out["problem"] = "payload differs from its digest"
        yield out


_WARC_TYPES = {"record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "date": pa.string(), "page_id": pa.int64(),
               "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
               "refers_to_record": pa.string(), "problem": pa.string()}


def read_warc(parts: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """The records of WARC parts or whole files; a revisit's size and digest are those of its full payload."""

    def records(packed: bytes) -> Iterator[dict]:
        for data in _members(packed):
            for r in warc_records(data):
                if not payloads:
                    r.pop("payload", None)
                yield r

    schema = ("record_type string, record_id string, url string, date string, page_id long, payload binary, payload_bytes long, "
              "payload_digest string, refers_to long, refers_to_record string, problem string")
    return _read(parts, records, _WARC_TYPES, schema, content)


def through_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page, without payloads.

    Null pages are empty payloads. Rows with a null key are compared among themselves and
    keep a null key; rows that repeat a key and its payload give equal records. An empty table gives no
    rows. Only the three named columns are read.
    """
    arc = durable(write_arc(pages, key, url, html))
    warc = durable(convert(arc, min_bytes))
    return read_warc(warc, payloads=False).where("record_type in ('response', 'revisit', 'metadata', 'damaged')")
