"""WARC: archives written record by record, and a splittable reader of gzip-per-record archives.

The reader's tasks take byte ranges. Each scans its range for the magic of a gzip member, takes a hit for a member only
if it decodes and its text begins with a WARC version and a full head, and owns the records whose members start inside
the range; the last one is read on past the range's end. No index, and no read from the start of an archive, is needed.

The writer's tasks each write one archive, under a name of its own until it is whole, so a retried task leaves no half
archive. Of records with equal payloads that with the largest id is the response and the others revisit it.

Edge cases: a null payload is empty; a null id never becomes the response of a payload that a record with an id has;
rows that repeat the largest id with the same payload are responses each; a null url leaves its head field out; line
ends in urls are percent-encoded; an empty table gives no records; extra columns are ignored. Archives of other writers: records of every type
are rows; ids that aren't this writer's numbers leave ``page_id`` and ``refers_to`` null and stand in ``record_id`` and ``refers_to_id``; a missing
digest is computed, a wrong one makes ``intact`` false; a revisit may lack length and digest, see ``resolved``; a damaged
member is passed over, and so is a gzip member that holds no record. Archives are reached through pyarrow's file systems (local, HDFS, S3, GCS), on driver and executors alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

MAGIC = b"\x1f\x8b\x08"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of a split and of a read, and the most bytes of a head.
SPLIT, READ, HEAD = 16_000_000, 1 << 18, 1 << 16
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, intact boolean"


def opened(uri: str):
    """File system and path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE)]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if revisit:
        head.append(("WARC-Profile", PROFILE))
        if refers_to is not None:
            head.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    block = http if revisit else http + payload
    head.append(("Content-Length", str(len(block))))
    text = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(text) + gz.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """``path, bytes, records`` of the archives of all rows of ``page_id, url, html``, one archive per task."""
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    # a row per payload and task at most is shuffled here, however often one payload occurs
    top = slim.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "top")
    known = slim.join(top, "sha", "left").select("page_id", "url", "html", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = opened(folder)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        part = f"{base}/_{context.partitionId():06d}-{context.taskAttemptId()}"
        out, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(part)
            ids, urls, texts, refers = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                ref = refers[i].as_py()
                out.write(record(ids[i].as_py(), urls[i].as_py(), texts[i].as_py().encode(), ref, ref is not None))
                n += 1
        if out:
            size = out.tell()
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return cut(known.mapInArrow(run, "path string, bytes long, records long"))


def parsed(text: bytes) -> tuple[dict[str, str], bytes] | None:
    """Head fields, in lower case, and block of a decoded member; None if it is no record."""
    if not text.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return None
    head, mark, rest = text.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return None
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    n = int(fields["content-length"])
    if len(rest) < n:
        return None
    return fields, rest[:n]


def member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """Text and end of the gzip member at a place, or None if none with a WARC head starts there."""
    gz = zlib.decompressobj(31)
    parts, total, pos, seen = [], 0, at, b""
    while not gz.eof:
        if pos >= size:
            return None
        file.seek(pos)
        data = file.read(min(4096 if pos == at else READ, size - pos))
        pos += len(data)
        try:
            got = gz.decompress(data)
        except zlib.error:
            return None
        parts.append(got)
        total += len(got)
        if len(seen) < 10:
            seen = (seen + got)[:10]
            if not b"WARC/1.1\r\n".startswith(seen) and not b"WARC/1.0\r\n".startswith(seen):
                return None
        if total <= HEAD + READ and total > HEAD and b"\r\n\r\n" not in b"".join(parts):
            return None
    return b"".join(parts), pos - len(gz.unused_data)


def records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, head and block of the records whose members start in a byte range."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(READ, end - at + len(MAGIC) - 1, size - at))
        hit = data.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        found = member(file, at, size)
        if found and (r := parsed(found[0])):
            yield at, *r
            at = found[1]
        else:
            at += 1


def sha1_of(field: str | None) -> str | None:
    """A declared SHA-1 in bare upper-case base32, whether it is written so or in hex; None if there is none."""
    kind, _, value = (field or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode()
    return value.upper() or None


def row_of(head: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD. The payload is the body of a stored HTTP message, else the block; a revisit has none, but may declare its length and digest."""

    def number(field: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(field, ""))
        return int(m[1]) if m else None

    declared, intact = sha1_of(head.get("warc-payload-digest")), None
    if head["warc-type"] == "revisit":
        n = head.get("x-payload-length", "")
        length, digest = int(n) if n.isdigit() else None, declared
    else:
        http = head.get("content-type", "").lower().replace(" ", "").startswith("application/http") or (head["warc-type"] == "response" and block.startswith(b"HTTP/"))
        payload = block.partition(b"\r\n\r\n")[2] if http else block
        length, digest = len(payload), digest32(payload)
        intact = None if declared is None else digest == declared
    return number("warc-record-id"), head.get("warc-target-uri"), length, digest, head["warc-type"], number("warc-refers-to"), head.get("warc-record-id"), head.get("warc-refers-to"), intact


def resolved(rows: DataFrame) -> DataFrame:
    """Rows of RECORD in which a revisit that declares no length or digest has those of the record it refers to, else of a response of equal digest."""
    told = rows.where("record_type <> 'revisit'")
    by_id = told.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("a")).select(F.col("record_id").alias("__id"), "a")
    by_digest = told.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("payload_bytes").alias("__n")).withColumnRenamed("payload_digest", "__digest")
    bare = (F.col("record_type") == "revisit") & (F.col("payload_bytes").isNull() | F.col("payload_digest").isNull())
    some = rows.where(bare).join(by_id, F.col("refers_to_id") == F.col("__id"), "left").withColumn("payload_digest", F.coalesce("payload_digest", "a.payload_digest"))
    some = some.join(by_digest, F.col("payload_digest") == F.col("__digest"), "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "a.payload_bytes", "__n"))
    return rows.where(~bare).unionByName(some.select(*rows.columns))


def read(spark: SparkSession, archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of archives (``path, bytes``), of all types, whose byte ranges are spread over tasks; see RECORD and ``row_of``."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    n = ranges.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for x in batch.to_pylist():
                fs, path = opened(x["path"])
                rows = []
                with fs.open_input_file(path) as file:
                    for _, head, block in records(file, x["bytes"], x["start"], min(x["bytes"], x["start"] + split)):
                        rows.append(row_of(head, block))
                        if len(rows) >= 5000:
                            yield packed(rows)
                            rows = []
                if rows:
                    yield packed(rows)

    return ranges.repartition(max(1, n), "path", "start").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, split: int = SPLIT) -> DataFrame:
    """The records of all pages, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_dir(spark)), split).drop("record_id", "refers_to_id", "intact")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((instr('0123456789abcdef', substr(h, (i * 5 // 4 + 1)::INT, 1)) - 1) * 16
    + instr('0123456789abcdef', substr(h, (i * 5 // 4 + 2)::INT, 1)) - 1) >> (3 - (i * 5) % 4)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""
