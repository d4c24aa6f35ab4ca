"""WARC archives of crawled pages: a deduplicating writer and a salvage reader.

Archives are written by Spark's own text writer, so that its commit protocol covers
retried and speculative tasks and any Hadoop file system will do. Each record is one
gzip member. A member ends with the high byte of its size, which is zero below 16 MiB;
the writer's line separator is that zero byte, so no stray byte enters the archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, materialize, scratch_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are always stored.
MIN_REVISIT_BYTES = 1000
#: Records of an archive, and about how many bytes of it, at most. A reader holds a whole archive.
RECORDS_PER_FILE, BYTES_PER_FILE = 4096, 64 << 20
#: Where a header mostly ends; a longer one is searched up to the next version line.
USUAL_HEADER_BYTES = 1 << 16

_MAGIC = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NEXT_LINE = re.compile(rb"\nWARC/1\.[01]\r\n")
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Compressed bytes that are inflated at a time: of a member's start, of the rest, and where damage is sought.
_FIRST_WINDOW, _WINDOW, _PIECE = 1 << 13, 1 << 16, 256
_HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}


# --- writing ---


def http_block(payload: bytes | None, n_bytes: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return head + (payload or b"")


def record_bytes(record_type: str, record_id: str, uri: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC record. A revisit holds the HTTP head of its page and no payload."""
    block = http_block(payload, n_bytes)
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri is not None else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("WARC-Profile", REVISIT_PROFILE if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, for records of any size."""
    packed = gzip.compress(record, 5, mtime=0)
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def page_urn(page_id) -> str:
    return "urn:page:" + ("none" if pd.isna(page_id) else str(int(page_id)))


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Each page with its payload, digest and the page that it revisits, if any.

    A null html is an empty payload. Among pages with equal payloads of at least
    ``min_bytes`` bytes, those with the largest page_id are responses and the others
    revisit it; a null page_id counts as smaller than any other. Repeated rows are
    records of their own. The choice is made on (page_id, digest) alone and pre-summed
    by digest, so a payload that a third of the pages share moves no texts; the texts
    move once, by page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    slim = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")).filter(F.col("payload_bytes") >= min_bytes)
    latest = materialize(
        slim.groupBy("payload_digest").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("earliest"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("ids"))
        .filter("latest IS NOT NULL AND (earliest < latest OR ids < n)")
        .select("payload_digest", "latest"),
        "latest",
    )
    # few rows, each a page that some later page repeats; one row for a page_id and payload
    revisits = slim.join(latest, "payload_digest").filter("page_id IS NULL OR page_id < latest").select(F.col("page_id").alias("of"), "payload_digest", "latest").distinct()
    planned = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    return planned.join(
        revisits.withColumnRenamed("payload_digest", "digest"),
        F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("digest")),
        "left",
    ).select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.col("latest").alias("refers_to"))


def write_archives(planned: DataFrame, path: str) -> None:
    """Write the records of ``plan_records`` to WARC files in ``path``.

    An archive has at most RECORDS_PER_FILE members and about BYTES_PER_FILE bytes, or
    one larger record; one that is full before its time is filled up with empty members.
    """
    bounded_batches(planned.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = 0, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                first = pd.isna(r.refers_to)
                record = record_bytes("response" if first else "revisit", page_urn(r.page_id), r.url, bytes(r.payload) if first else None, int(r.payload_bytes), r.payload_digest, None if first else page_urn(r.refers_to))
                packed = member(record)
                if rows and size + len(packed) > BYTES_PER_FILE:
                    # the writer counts rows: empty members take up the rest of the archive
                    out += [_EMPTY_MEMBER[:-1]] * (RECORDS_PER_FILE - rows)
                    rows, size = 0, 0
                out.append(packed[:-1])
                rows, size = (rows + 1) % RECORDS_PER_FILE, size + len(packed) if rows + 1 < RECORDS_PER_FILE else 0
                if len(out) >= 512 or size > BYTES_PER_FILE // 8:
                    yield pd.DataFrame({"member": out})
                    out = []
            if out:
                yield pd.DataFrame({"member": out})

    packed = planned.mapInPandas(pack, "member binary").select(F.col("member").cast("string").alias("value"))
    packed.write.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# --- salvage reading ---


@dataclass
class Record:
    """A whole record; ``checked`` if a digest of its block was there and right."""

    start: int
    end: int
    fields: dict[str, str]
    block: bytes
    checked: bool = False


def digest_bytes(label: str) -> tuple[str, bytes | None]:
    """Algorithm and digest of a labelled digest, in hex or base32; None where the form is unknown."""
    kind, _, text = label.partition(":")
    kind, text = kind.strip().lower(), text.strip()
    if kind not in _HASHES:
        return kind, None
    size = _HASHES[kind]().digest_size
    try:
        if len(text) == 2 * size:
            return kind, bytes.fromhex(text)
        found = base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        return kind, None
    return kind, found if len(found) == size else None


def _matches(label: str, data: bytes) -> bool | None:
    """Whether data has a labelled digest; None where there is none that can be told."""
    kind, digest = digest_bytes(label)
    return None if digest is None else _HASHES[kind](data).digest() == digest


def parse_record(data: bytes, at: int) -> tuple[Record | None, str]:
    """The record that starts at ``at``, or why there is none."""
    if not (line := _LINE.match(data, at)):
        return None, "no version line"
    head_end = data.find(b"\r\n\r\n", line.end() - 2, line.end() + USUAL_HEADER_BYTES)
    if head_end < 0:
        following = _NEXT_LINE.search(data, line.end())
        head_end = data.find(b"\r\n\r\n", line.end() - 2, following.start() + 1 if following else len(data))
    if head_end < 0:
        return None, "header does not end"
    fields: dict[str, str] = {}
    for row in data[line.end() : head_end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None, "malformed header line"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return None, "no content length"
    begin, end = head_end + 4, head_end + 4 + int(length)
    if end + 4 > len(data):
        return None, "record is cut short"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, "record end is missing"
    block = data[begin:end]
    right = _matches(fields.get("warc-block-digest", ""), block)
    if right is False:
        return None, "block digest differs"
    return Record(at, end + 4, fields, block, right is True), ""


def inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, its end, and what is wrong, if anything.

    Only the member is read, window by window, however long the archive is.
    """
    engine, view, out, place = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while not engine.eof and place < len(data):
            window = view[place : place + (_WINDOW if out else _FIRST_WINDOW)]
            out.append(engine.decompress(window))
            place += len(window)
    except zlib.error:
        return b"", at, "member does not decompress"
    if not engine.eof:
        return b"", at, "member is cut short"
    return b"".join(out), place - len(engine.unused_data), ""


def inflate_damaged(data: bytes, at: int) -> bytes:
    """What a member holds before its fault or cut."""
    engine, view, out, place, step = zlib.decompressobj(31), memoryview(data), [], at, _PIECE
    while place < len(data) and not engine.eof:
        before = engine.copy()
        try:
            out.append(engine.decompress(view[place : place + step]))
        except zlib.error:
            if step == 1:
                break
            engine, step = before, 1  # byte by byte up to the fault
            continue
        place += step
    return b"".join(out)


def place_of(data: bytes, at: int, length: int) -> int:
    """Where the member at ``at`` has given ``length`` bytes of content."""
    engine, view, size, place, step = zlib.decompressobj(31), memoryview(data), 0, at, _PIECE
    while size < length:
        before = engine.copy()
        try:
            more = len(engine.decompress(view[place : place + step]))
        except zlib.error:
            more = length  # the content is complete before the fault
        if step > 1 and size + more >= length:
            engine, step = before, 1
            continue
        size, place = size + more, place + step
    return place


def records_in(body: bytes, checked_only: bool = False) -> tuple[list[Record], str]:
    """The whole records of a member's content, and why the first that isn't whole isn't."""
    found, inside, reason = [], 0, ""
    while inside < len(body):
        record, why = parse_record(body, inside)
        if record and (record.checked or not checked_only):
            found.append(record)
            inside = record.end
            continue
        reason = reason or why or "member does not decompress"
        following = _NEXT_LINE.search(body, inside + 1)
        inside = following.start() + 1 if following else len(body)
    return found, reason


def parse_member(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The records of the gzip member at ``at``, where they end, and what is wrong.

    Of a member that is cut short, the records before the cut are good. Of one that does
    not decompress, only those are whose own digest says so: what comes out before a
    fault is noticed may be wrong already.
    """
    body, end, fault = inflate(data, at)
    if not fault:
        found, why = records_in(body)
        return [Record(at, end, r.fields, r.block, r.checked) for r in found], end, why
    found, _ = records_in(inflate_damaged(data, at), checked_only=fault != "member is cut short")
    if not found:
        return [], at, fault
    end = place_of(data, at, found[-1].end)
    return [Record(at, end, r.fields, r.block, r.checked) for r in found], end, fault


def salvage(data: bytes) -> Iterator[tuple[str, int, int, Record | str]]:
    """Records of an archive, and the byte ranges that hold none.

    Yields ("record", start, end, record), ("gap", start, end, reason) and ("padding",
    start, end, reason) for an empty member, in order; together they cover every byte.
    Members and plain records may be mixed. After a failed check the reader looks for the
    next member or version line that leads to a whole record and goes on there, so damage
    costs the records that it touches and no others; a member of several records keeps
    those before a cut or fault. Block digests may be hex or base32, and one of unknown
    form is not checked. An empty archive yields nothing.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        records, end, why = [], at, "no record starts here"
        if data.startswith(_MAGIC, at):
            records, end, why = parse_member(data, at)
        elif _LINE.match(data, at):
            record, why = parse_record(data, at)
            if record:
                records, end = [record], record.end
        if not why or records:
            if bad is not None:
                yield "gap", bad, at, reason
                bad = None
            for record in records:
                yield "record", at, end, record
            if not records:
                yield "padding", at, end, "empty member"
            if why in ("member does not decompress", "member is cut short"):
                bad, reason = end, why
            elif why:
                yield "gap", at, end, why
            at = end
            continue
        if bad is None:
            bad, reason = at, why
        following = _START.search(data, at + 1)
        at = following.start() if following else len(data)
    if bad is not None and bad < len(data):
        yield "gap", bad, len(data), reason


RECORD_SCHEMA = "kind string, archive string, start long, `end` long, reason string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and every quarantined byte gap of the archives in ``path``.

    ``kind`` is record, gap or padding; the last two have archive, byte range and reason,
    and nulls elsewhere. payload_bytes is the length that the HTTP head declares, which
    for a revisit is that of the page. payload_digest is bare lower-case hex whatever the
    archive's form; one of unknown form stays as it is and is not checked. A record whose
    payload does not match its payload digest is a gap too. A folder without files gives
    no rows. An archive is read whole by one task, so it must fit a worker, and stay
    below 2 GiB, Spark's limit for a binary file; ``write_archives`` keeps far below.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                out: list[tuple] = []
                for kind, start, end, found in salvage(bytes(content)):
                    out.append(_row(kind, archive, start, end, found, with_payload))
                    if len(out) >= 512:
                        yield pd.DataFrame(out, columns=_COLUMNS)
                        out = []
                yield pd.DataFrame(out, columns=_COLUMNS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, RECORD_SCHEMA)


_COLUMNS = ["kind", "archive", "start", "end", "reason", "record_type", "record_id", "refers_to", "uri", "payload_digest", "payload_bytes", "payload"]


def _row(kind: str, archive: str, start: int, end: int, found: Record | str, with_payload: bool) -> tuple:
    if kind != "record":
        return (kind, archive, start, end, found, None, None, None, None, None, None, None)
    fields = found.fields
    head, _, payload = found.block.partition(b"\r\n\r\n")
    declared = re.search(rb"(?im)^content-length:\s*(\d{1,15})\s*$", head)
    n_bytes = int(declared[1]) if declared else len(payload)
    label = fields.get("warc-payload-digest", "")
    known = digest_bytes(label)[1]
    digest = known.hex() if known else label.partition(":")[2] or None
    if fields.get("warc-type") != "revisit" and _matches(label, payload) is False:
        return ("gap", archive, start, end, "payload digest differs", None, None, None, None, None, None, None)
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return (kind, archive, start, end, None, fields.get("warc-type"), bare("warc-record-id"), bare("warc-refers-to"), fields.get("warc-target-uri"), digest, n_bytes, payload if with_payload else None)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives and read the archives back."""
    path = scratch_path(spark, "warc")
    write_archives(plan_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) AS bigint)")
    return (
        read_archives(spark, path, with_payload=False)
        .filter("kind = 'record'")
        .select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    )


QUERIES = {"op3_warc": op3_warc}
ORACLE_SQL = {
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM m
"""
}
