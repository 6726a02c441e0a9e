"""Legacy archives: from ARC files to WARC files and back to rows.

``write_arc`` stores pages as ARC files, ``convert`` turns any ARC files into
WARC files, ``read_warc`` reads those.  The converter follows what an ARC file
says of itself: the version block names the fields of its record lines (four
after the URL in version 1, nine in version 2), and each line declares the bytes
that follow.  From these it makes up what a WARC record wants: an identifier
(a name-based UUID of URL, date and content), an ISO timestamp, the type
(``response`` for HTTP messages, ``resource`` for all else), and SHA-256 digests
of block and payload.  Of records with equal payloads of ``LEAST`` bytes or
more, the earliest (then the one with the smallest page number) stays; others
become ``revisit`` records that name it and keep their HTTP head only.

Files are written by Spark's text sink, a record a row, with the formats' own
record ends as line ends, so they land on whatever file system the path names;
they are compressed, and files are read compressed or not.  A file has at most ``PER_FILE`` records, so that reading one takes bounded
memory.

Defined results: a null html is an empty payload; a null url becomes a
placeholder, blanks and control characters in one are escaped; repeated rows
become equal records, all of the same type; a file cut short yields its whole
records, then an error row; an empty table gives no files and no rows; extra
columns are ignored.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import materialize, scratch_path

# The fields of record lines, by version.
FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEAST, PER_FILE = 100, 2_000
#: Groups of equal payloads are broadcast up to this many; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 50_000
EPOCH = datetime.datetime(1970, 1, 1)


def arc_head(version: str, name: str) -> bytes:
    """The version block that opens an ARC file."""
    legend = "URL IP-address Archive-date Content-type Archive-length" if version == "1" else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = f"{version} 0 lectern\n{legend}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 19700101000000 text/plain" + ("" if version == "1" else f" 200 - - 0 {name}") + f" {len(body)}\n"
    return line.encode() + body


def arc_date(page_id: int | None) -> str:
    """A capture time for a page: so many seconds after 1970, within what the format can say."""
    try:
        return (EPOCH + datetime.timedelta(seconds=page_id or 0)).strftime("%Y%m%d%H%M%S").zfill(14)
    except OverflowError:
        return "99991231235959" if page_id > 0 else "00010101000000"


def arc_record(page_id: int | None, url: str | None, html: str | None, version: str, name: str) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "http://unknown.invalid/"
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    message = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    extra = "" if version == "1" else f"200 - - 0 {name} "
    return f"{url} 0.0.0.0 {arc_date(page_id)} text/html {extra}{len(message)}\n".encode() + message


def parse_arc(data: bytes):
    """(fields, content) of every record; ``({"error": what}, b"")`` at the end of a broken file."""
    at, fields = 0, FIELDS["1"]
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        own = FIELDS["1"] if line.startswith("filedesc:") and len(line.split(" ")) == 5 else FIELDS["2"] if line.startswith("filedesc:") else fields
        values = line.rsplit(" ", len(own) - 1)
        if end < 0 or len(values) != len(own) or not values[-1].isdigit():
            yield {"error": f"no record line at byte {at}"}, b""
            return
        record = dict(zip(own, values, strict=True))
        start, at = end + 1, end + 1 + int(record["length"])
        if at > len(data):
            yield {"error": f"{at - len(data)} bytes are missing after byte {len(data)}"}, b""
            return
        content = data[start:at]
        if line.startswith("filedesc:"):
            fields = FIELDS.get(content[:1].decode("latin-1"), fields)
        yield record, content


def inflated(data: bytes) -> bytes:
    """The content of a file, whether it is compressed (as one member or a member a record) or not."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def head_and_payload(content: bytes) -> tuple[bytes, bytes]:
    """An HTTP message apart; anything else is all payload."""
    if content.startswith(b"HTTP/"):
        head, mark, payload = content.partition(b"\r\n\r\n")
        if mark:
            return head + mark, payload
        head, mark, payload = content.partition(b"\n\n")
        if mark:
            return head + mark, payload
    return b"", content


def header_of(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def warc_date(date: str) -> str:
    d = (re.sub(r"[^0-9]", "", date) + "00010101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


PARSED = T.StructType(
    [
        T.StructField("record_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("ip", T.StringType()),
        T.StructField("date", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("head", T.BinaryType()),
        T.StructField("payload", T.BinaryType()), T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
_PARSED = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of ARC files; without ``payload``, all but the content."""

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for record, content in parse_arc(inflated(value.as_py())):
                    if "error" in record:
                        rows.append({"error": record["error"]})
                    elif not record["url"].startswith("filedesc:"):
                        head, body = head_and_payload(content)
                        digest, page = hashlib.sha256(body).hexdigest(), header_of(head, "X-Page-Id")
                        key = f"{record['url']} {record['date']} {page} {digest}"
                        rows.append({
                            "record_id": f"urn:uuid:{uuid.uuid5(NAMES, key)}", "url": record["url"], "ip": record["ip"], "date": warc_date(record["date"]),
                            "page_id": int(page) if page and re.fullmatch(r"-?\d{1,19}", page) else None,
                            "head": head, "payload": body if payload else None, "digest": digest, "bytes": len(body),
                        })
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, _PARSED)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _PARSED)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, PARSED)


def write_records(rows: DataFrame, render, opening, path: str, end: str) -> None:
    """Writes ``render(row)`` for every row; each file begins with ``opening(number)`` and has ``PER_FILE`` more records at most."""

    def run(batches):
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for row in batch.slice(at, 200).to_pylist():
                    if n % PER_FILE == 0:
                        out.append(opening(n // PER_FILE))
                    out.append(render(row))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", end).option("maxRecordsPerFile", PER_FILE + 1).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, version: str = "2") -> None:
    """Stores ``page_id, url, html`` as ARC files."""
    name = "pages.arc"
    write_records(
        pages.select(F.col("page_id").cast("long"), "url", "html"),
        lambda row: arc_record(row["page_id"], row["url"], row["html"], version, name),
        lambda number: arc_head(version, f"{number}-{name}"), path, "\n",
    )


def warc_record(row: dict) -> bytes:
    head, payload, revisit = row["head"] or b"", row["payload"] or b"", row["first_id"] is not None
    block = head if revisit else head + payload
    kind = "revisit" if revisit else "response" if head else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Target-URI: {row['url']}", f"WARC-Date: {row['date']}", f"WARC-IP-Address: {row['ip']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"Content-Type: {'application/http;msgtype=response' if head else 'application/octet-stream'}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['first_id']}>", f"WARC-Refers-To-Target-URI: {row['first_url']}", f"WARC-Refers-To-Date: {row['first_date']}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block


def warc_info(number: int) -> bytes:
    block = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(NAMES, f"warcinfo {number}")
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Writes WARC files with what the ARC files under ``arc_path`` hold."""
    slim = read_arc(spark, arc_path, payload=False).where(F.col("error").isNull()).select("digest", "bytes", "date", "page_id", "record_id", "url")
    order = F.struct("date", "page_id", "record_id", "url")
    groups = slim.where(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    groups = materialize(groups.select("digest", "first"), "warc-groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    records = read_arc(spark, arc_path).where(F.col("error").isNull()).join(groups, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("bytes") >= LEAST) & (F.col("record_id") != F.col("first.record_id"))
    typed = records.select(
        "record_id", "url", "ip", "date", "head", F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"), "digest",
        *[F.when(again, F.col(f"first.{c}")).alias(f"first_{n}") for c, n in (("record_id", "id"), ("url", "url"), ("date", "date"))],
    )
    write_records(typed, warc_record, warc_info, warc_path, "\r\n\r\n")


READ = "record_id string, type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, error string"
_READ = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("error", pa.string())])


def parse_warc(data: bytes):
    """(headers in lower case, block) of every record; ``({"error": what}, b"")`` at the end of a broken file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdigit():
            yield {"error": f"no record at byte {at}"}, b""
            return
        start, at = end + 4, end + 4 + int(length)
        if at > len(data):
            yield {"error": f"{at - len(data)} bytes are missing after byte {len(data)}"}, b""
            return
        yield headers, data[start:at]
        if data[at : at + 4] == b"\r\n\r\n":
            at += 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, resource or revisit.  Payloads that are there are hashed again; a wrong digest is an error row."""

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for headers, block in parse_warc(inflated(value.as_py())):
                    if "error" in headers:
                        rows.append({"error": headers["error"]})
                        continue
                    kind = headers.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    head, payload = head_and_payload(block) if kind != "resource" else (b"", block)
                    digest, page = headers.get("warc-payload-digest", "").removeprefix("sha256:"), header_of(head, "X-Page-Id")
                    size = len(payload) if kind != "revisit" else int(header_of(head, "Content-Length") or 0)
                    wrong = kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest
                    rows.append({
                        "record_id": headers.get("warc-record-id", "").strip("<>"), "type": kind, "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
                        "page_id": int(page) if page and re.fullmatch(r"-?\d{1,19}", page) else None, "payload_bytes": size, "payload_digest": digest,
                        "refers_to_id": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, "error": "wrong payload digest" if wrong else None,
                    })
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, READ)


def round_trip(pages: DataFrame, version: str = "2") -> DataFrame:
    """Pages to ARC to WARC and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc)
    rows = materialize(read_warc(spark, warc), "warc-rows")
    found = rows.where(F.assert_true(F.col("error").isNull(), F.col("error")).isNull()).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to_id"
    )
    firsts = rows.join(rows.select(F.col("refers_to_id").alias("record_id")).where("record_id is not null").distinct(), "record_id", "left_semi")
    names = firsts.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"))
    return found.join(names, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
