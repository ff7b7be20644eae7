"""WARC: archives of one gzip member per record, and a salvage reader.

The writer stores a page's payload once: among pages of equal payload (of min_bytes or more) the one
with the largest id is the response, the others are revisit records that name it. The reader checks
every member and block digest; after a failed check it searches for the next member or version line
that holds a whole record, goes on from there, and reports the bytes between as a quarantined gap.

Defined results: a null payload is empty; rows repeated with the same id are written each, all of them
as responses if that id is the largest of its payload; an empty table gives no files and no rows; a
null id is written and read back as null and is a response only if no other id has that payload. Records
have ids of their own; that of a response that stands once is known from its page_id and payload, so that revisits can name it.
A length that the file can't hold, or that its member doesn't, is damage; no other length is refused.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectorium.llm._io import frugal, saved, scratch, ship, table

VERSION = b"WARC/1.1\r\n"
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of the payload's SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id, own: str = "") -> str:
    """The record id of a page; own tells its records apart: a payload's digest, and a place in the archives
    where that isn't enough."""
    return f"<urn:lectorium:page:{'null' if page_id is None else page_id}{own and ':' + own}>"


def from_urn(value: str | None):
    m = re.fullmatch(r"<urn:lectorium:page:(null|-?\d+)(:[\w-]+)?>", value or "")
    return None if not m or m[1] == "null" else int(m[1])


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One uncompressed record. Header values are kept on one line."""
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers.items() if v is not None)
    return VERSION + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


#: The date of records that were made from a table, which has no time of capture.
DATE = "2000-01-01T00:00:00Z"


def page_record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, own: str = "", date: str = DATE) -> bytes:
    """The record of a page: an HTTP response with its payload, or a revisit that holds its header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, digest = head if revisit else head + payload, digest32(payload)
    return record(
        {
            "WARC-Type": "revisit" if revisit else "response",
            "WARC-Record-ID": urn(page_id, digest + (own and f"-{own}")),
            "WARC-Date": date,
            "WARC-Target-URI": url,
            "Content-Type": "application/http; msgtype=response",
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Block-Digest": f"sha1:{digest32(block)}",
            "WARC-Refers-To": urn(refers_to, digest) if revisit else None,
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        },
        block,
    )


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes]:
    """The payload's full length and what the record holds of it."""
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return len(block), block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return len(block), block
    stated = re.search(rb"\r\ncontent-length:\s*(\d{1,18})\s*(\r\n|$)", head, re.I)
    return int(stated[1]) if stated and headers.get("warc-type") == "revisit" else len(body), body


def member(raw: bytes) -> bytes:
    """raw as one gzip member, the same bytes at every run."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _parse(raw: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and length of the whole record at the start of raw; None if it isn't one."""
    if not raw.startswith(b"WARC/1."):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return None
    length = int(headers["content-length"])
    block = raw[end + 4 : end + 4 + length]
    if len(block) < length or raw[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
        return None
    if "warc-block-digest" in headers and headers["warc-block-digest"].removeprefix("sha1:") != digest32(block):
        return None
    return headers, block, end + 8 + length


def _stated(head: bytes) -> int | None:
    """The whole length of the record that begins with head, None while its header goes on, -1 if it has none."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    m = re.search(rb"\r\ncontent-length:\s*(\d{1,18})\s*\r\n", head[: end + 4], re.I)
    return end + 8 + int(m[1]) if m else -1


def _member_at(f, start: int) -> tuple[bytes, int] | None:
    """The inflated member that begins at start and where the next one does; None if it's damaged. It may
    not hold more than the record in it states, so a damaged member can't fill the memory."""
    f.seek(start)
    inflate, out, size, at, stated = zlib.decompressobj(31), [], 0, start, None
    try:
        while not inflate.eof:
            data = f.read(STEP)
            if not data:
                return None
            at += len(data)
            while data:
                piece = inflate.decompress(data, STEP * 16)
                size += len(piece)
                out.append(piece)
                if stated is None:
                    out = [b"".join(out)]
                    if not out[0].startswith(b"WARC/1."[: len(out[0])]):
                        return None
                    stated = _stated(out[0])
                if stated is not None and size > stated:
                    return None
                data = inflate.unconsumed_tail
                if inflate.eof:
                    break
    except zlib.error:
        return None
    return b"".join(out), at - len(inflate.unused_data)


def _plain_at(f, start: int, size: int):
    """The uncompressed record at start, read piece by piece up to the length that it states, which the file
    must have."""
    f.seek(start)
    head = b""
    while (total := _stated(head)) is None:
        data = f.read(STEP)
        if not data:
            return None
        head += data
        if not head.startswith(b"WARC/1."[: len(head)]):
            return None
    if total < 0 or start + total > size:
        return None
    parts, have = [head], len(head)
    while have < total:
        data = f.read(min(1 << 20, total - have))
        if not data:
            return None
        parts.append(data)
        have += len(data)
    return _parse(b"".join(parts)[:total])


def _next(f, start: int, size: int) -> int:
    """The first offset from start on where a member or a version line may begin; size if there's none."""
    back = b""
    f.seek(start)
    at = start
    while at < size:
        data = f.read(STEP)
        if not data:
            break
        window = back + data
        found = [i for i in (window.find(MAGIC), window.find(b"WARC/1.")) if i >= 0]
        if found:
            return at - len(back) + min(found)
        at += len(data)
        back = window[-6:]
    return size


def read_records(f, size: int):
    """Yield ("record", start, end, headers, block) and ("gap", start, end, None, None) in file order."""
    at, gap = 0, None
    while at < size:
        f.seek(at)
        lead, got = f.read(7), None
        if lead.startswith(MAGIC):
            whole = _member_at(f, at)
            if whole:
                parsed = _parse(whole[0])
                if parsed and parsed[2] == len(whole[0]):
                    got = (parsed[0], parsed[1], whole[1])
        elif lead == b"WARC/1.":
            parsed = _plain_at(f, at, size)
            if parsed:
                got = (parsed[0], parsed[1], at + parsed[2])
        if got:
            if gap is not None:
                yield "gap", gap, at, None, None
                gap = None
            yield "record", at, got[2], got[0], got[1]
            at = got[2]
        else:
            gap = at if gap is None else gap
            at = _next(f, at + 1, size)
    if gap is not None:
        yield "gap", gap, size, None, None


@frugal
def _write_partition(batches, folder: str, roll_bytes: int):
    """Write rows to archives of about roll_bytes each. A file appears under its name only when whole."""
    from pyspark import TaskContext

    filesystem, base = pafs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    number, count, sink, written = 0, 0, None, 0

    def close():
        nonlocal sink, number
        sink.close()
        name = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
        filesystem.move(part, f"{base}/{name}")
        number += 1
        sink = None
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count]), pa.array([written])], names=["file", "records", "bytes"])

    for batch in batches:
        for page_id, url, html, refers_to, revisit, alone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sink is None:
                part = f"{base}/_{context.taskAttemptId()}-{number:04d}.open"
                sink, count, written = filesystem.open_output_stream(part), 0, 0
            own = "" if alone else f"{context.partitionId()}-{number}-{count}"  # other records may have this page's id
            raw = member(page_record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, revisit, own))
            sink.write(raw)
            count, written = count + 1, written + len(raw)
            if written >= roll_bytes:
                yield close()
    if sink is not None:
        yield close()


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 128 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as archives below folder; returns file, records, bytes.

    The table of payload groups is written first, so that the join reads two plain shuffles and Spark
    can split the partition of a payload that very many pages share.
    """
    ship(pages.sparkSession)
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload", F.sha1(F.col("html").cast("binary")))
    per = keyed.groupBy("payload", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = saved(per.groupBy("payload").agg(F.max("page_id").alias("kept"), F.max_by("n", "page_id").alias("copies")), "warc-groups")
    marked = keyed.join(groups, "payload")
    revisit = (F.octet_length("html") >= min_bytes) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    rows = marked.select("page_id", "url", "html", F.when(revisit, F.col("kept")).alias("refers_to"), revisit.alias("revisit"), F.coalesce(F.col("page_id").eqNullSafe(F.col("kept")) & (F.col("copies") == 1), F.lit(False)).alias("alone"))
    return saved(rows.mapInArrow(lambda it: _write_partition(it, folder, roll_bytes), "file string, records long, bytes long"), "warc-files")


RECORD_SCHEMA = "file string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"


@frugal
def _read_files(batches, with_block: bool):
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            filesystem, name = pafs.FileSystem.from_uri(path)
            size, rows, held = filesystem.get_file_info(name).size, [], 0
            with filesystem.open_input_file(name) as raw:
                f = io.BufferedReader(raw, 1 << 18) if not hasattr(raw, "size") else raw
                for kind, start, end, h, block in read_records(f, size):
                    if kind == "gap":
                        rows.append((path, start, end, None, None, None, None, "gap", None, None))
                    else:
                        full, body = payload_of(h, block)
                        rows.append(
                            (
                                path, start, end, from_urn(h.get("warc-record-id")), h.get("warc-target-uri"), full,
                                h.get("warc-payload-digest", "").removeprefix("sha1:"), h.get("warc-type"), from_urn(h.get("warc-refers-to")), body if with_block else None,
                            )
                        )
                        held += len(block) if with_block else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_warc(files: DataFrame, with_block: bool = False) -> DataFrame:
    """All records, and a row of record_type "gap" for every quarantined range, of the files(file) given."""
    ship(files.sparkSession)
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(lambda it: _read_files(it, with_block), RECORD_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record per row of pages and return what the archives hold."""
    files = write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch(spark, "warc"), min_bytes=0)
    whole = F.when(F.col("record_type") == "gap", F.raise_error(F.concat(F.lit("damaged archive "), "file"))).otherwise(F.col("record_type"))
    return read_warc(files).withColumn("record_type", whole).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a digest: its 160 bits in groups of five.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, h, sha1(h) AS x FROM p),
k AS (SELECT x, max(page_id) AS kept FROM d GROUP BY x),
u AS (
  SELECT DISTINCT x, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(8), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (g * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::BIGINT, CASE WHEN i < 4 THEN 1 ELSE 0 END)), 'string_agg', '')), 'string_agg', '') AS b FROM d
)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, u.b AS payload_digest, CASE WHEN d.page_id = k.kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = k.kept THEN NULL ELSE k.kept END AS refers_to
FROM d JOIN k ON k.x = d.x JOIN u ON u.x = d.x
"""
