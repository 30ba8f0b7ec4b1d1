"""Legacy archives: write and parse ARC 1 and 2, convert them to WARC 1.1, read WARC back.

Archives are gzip files of at most ``PER_FILE`` records that Spark's own writer commits, so a lost task leaves none
behind, and any store that Spark reaches can hold them. A record is a row whose bytes the text writer ends by the
format's record separator. Readers take one file at a time and walk it by the declared lengths.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

PER_FILE = 1000
BATCH_BYTES = 4 << 20
PIECE = 1 << 14
REVISIT_FROM = 100
# fixed values of the formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARC_SCHEMA = "file string, offset long, version int, url string, ip string, date string, mime string, status int, head binary, payload binary"
WARC_SCHEMA = "file string, offset long, type string, record_id string, fields map<string,string>, head binary, payload binary"


def inflate(data: bytes) -> bytes:
    """A gzip file of one or many members, or plain bytes as they are. A member that breaks off ends the file."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        d, piece = zlib.decompressobj(31), PIECE
        try:
            while at < len(data) and not d.eof:  # what comes before a fault is kept
                out.append(d.decompress(view[at : at + piece]))
                at, piece = at + piece, min(piece * 2, PIECE << 6)
        except zlib.error:
            break
        at = min(at, len(data)) - len(d.unused_data)
    return b"".join(out)


def _http(body: bytes) -> tuple[bytes, bytes]:
    """Head of an HTTP message, with its blank line, and payload; no head if it isn't one."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()], body[m.end() :]) if m else (body, b"")


def parse_arc(data: bytes) -> Iterator[tuple]:
    """``(offset, version, url, ip, date, mime, status, head, payload)`` of each record, version blocks included.

    The version comes from the block that a ``filedesc:`` line opens; until one is seen, lines have version 1's fields.
    A line that isn't a header is passed over to the next line; a record cut short keeps the bytes that are there.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        begin, start = at, (end + 1 if end >= 0 else len(data))
        at = start
        if not line:
            continue
        opens = line.startswith(b"filedesc:")
        if opens:
            version = 2 if re.match(rb"2 ", data[start : start + 8]) else 1
        parts = line.rsplit(b" ", 9 if version == 2 else 4)
        if opens and len(parts) != (10 if version == 2 else 5):
            parts = line.rsplit(b" ", 4)
        if len(parts) not in (5, 10) or not parts[-1].isdigit() or not re.fullmatch(rb"\d{4,14}", parts[2]):
            continue
        at = start + int(parts[-1])
        body = data[start:at]
        url, ip, date, mime = (x.decode("utf-8", "replace") for x in parts[:4])
        head, payload = (b"", body) if opens else _http(body)
        status = int(parts[4]) if len(parts) == 10 and parts[4].isdigit() else None
        if status is None and (m := re.match(rb"HTTP/\S+ (\d{3})", head)):
            status = int(m[1])
        yield begin, version, url, ip, date, mime, status, head, payload


def parse_warc(data: bytes) -> Iterator[tuple]:
    """``(offset, type, record_id, fields, head, payload)`` of each record; field names in lower case.

    A record without a readable length goes to the next record, or to the end.
    """
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        fields = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "0")
        if size.isdecimal():
            n = int(size)
        else:
            end = data.find(b"\r\n\r\nWARC/1.", stop + 4)
            n = (end if end >= 0 else len(data.removesuffix(b"\r\n\r\n"))) - stop - 4
        block = data[stop + 4 : stop + 4 + n]
        head, payload = _http(block) if "msgtype=response" in fields.get("content-type", "") else (b"", block)
        yield at, fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields, head, payload
        at = stop + 4 + n


def _read(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    cols = [x.split(" ") for x in schema.split(", ")]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], types[t]) for c, (_, t) in zip(zip(*rows, strict=True), cols, strict=True)], [n for n, _ in cols])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, size = [], 0
                for r in parse(inflate(content.as_py())):
                    rows.append((name.as_py(), *r))
                    size += len(r[-1]) + len(r[-2])
                    if size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, columns of ``ARC_SCHEMA``."""
    return _read(spark, path, parse_arc, ARC_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``, columns of ``WARC_SCHEMA``."""
    return _read(spark, path, parse_warc, WARC_SCHEMA)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", per_file: int = PER_FILE) -> None:
    """``pages(page_id, url, html)`` as ARC files, versions 1 and 2 in turn by partition; a null html is empty.

    A file holds ``per_file`` records; readers hold a file whole, so long pages want fewer.

    The HTTP head carries the page's id. White space in a url is percent-encoded; a null url becomes ``page:<id>``.
    """

    def run(batches):
        version = 1 + TaskContext.get().partitionId() % 2
        n = 0
        for b in batches:
            rows, size = [], 0
            for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), strict=True):
                if n % per_file == 0:
                    body = f"{version} 0 barloom\n{ARC_FIELDS[version]}\n".encode()
                    more = " 200 - - 0 - " if version == 2 else " "
                    rows.append(f"filedesc://pages-{n // per_file}.arc 0.0.0.0 {date} text/plain{more}{len(body)}\n".encode() + body)
                    n += 1
                html = html or b""
                own = f"X-Page-Id: {page}\r\n" if page is not None else ""
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode() + html
                url = re.sub(r"\s", lambda m: "".join(f"%{x:02X}" for x in m[0].encode()), f"page:{page}" if url is None else url) or "-"
                more = f" 200 {zlib.crc32(html):08x} - {n} pages-{n // per_file}.arc " if version == 2 else " "
                rows.append(f"{url} 0.0.0.0 {date} text/html{more}{len(body)}\n".encode() + body)
                n += 1
                size += len(body)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    lines = pages.select("page_id", "url", "html").mapInArrow(run, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def _field(head: str, name: str):
    return F.regexp_extract(F.col(head).cast("string"), rf"(?im)^{name}: *([^\r\n]*)", 1)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, per_file: int = PER_FILE) -> None:
    """Convert every ARC record: identifiers, timestamps, types and digests are synthesised from what ARC says.

    ``filedesc`` becomes warcinfo, an HTTP message response, anything else resource. Of responses with equal payloads
    of ``REVISIT_FROM`` bytes or more, that of the smallest page id (none: the smallest identifier) stays and the
    others become revisits. A short date is padded to its earliest moment.
    """
    arc = read_arc(spark, arc_path)
    day = F.concat(F.col("date"), F.substring(F.lit("00000101000000"), F.length("date") + 1, 14))
    at = F.format_string("%s-%s-%sT%s:%s:%sZ", *(F.substring(day, i, n) for i, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))))
    known = arc.select(
        "url",
        "ip",
        "mime",
        "head",
        "payload",
        at.alias("at"),
        F.when(F.col("url").startswith("filedesc:"), "warcinfo").when(F.length("head") > 0, "response").otherwise("resource").alias("kind"),
        F.sha2("payload", 256).alias("digest"),
        F.length("payload").cast("long").alias("n"),
        F.expr("try_cast(nullif({}, '') as bigint)".format("regexp_extract(cast(head as string), '(?im)^X-Page-Id: *([^\\r\\n]*)', 1)".replace("\\", "\\\\"))).alias("page_id"),
    )
    h = F.md5(F.concat_ws("|", "url", "at", "kind", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    known = known.withColumn("id", F.format_string("urn:uuid:%s-%s-3%s-a%s-%s", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12)))))
    shared = (
        known.where((F.col("kind") == "response") & (F.col("n") >= REVISIT_FROM))
        .groupBy("digest")
        .agg(F.count("*").alias("many"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "id", "url", "at")).alias("first"))
        .where("many > 1")
        .select(F.col("digest").alias("d"), "first")
    )
    shared = staged(shared, "revisits")
    both = known.join(shared, (F.col("digest") == F.col("d")) & (F.col("kind") == "response") & (F.col("n") >= REVISIT_FROM), "left")
    again = F.col("first").isNotNull() & ~F.when(F.col("first.page_id").isNotNull(), F.col("page_id").eqNullSafe(F.col("first.page_id"))).otherwise(F.col("id") == F.col("first.id"))
    both = both.withColumn("again", again)
    block = F.when(F.col("again"), F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.format_string("<%s>", "id")),
        line("WARC-Date", F.col("at")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(
            F.col("again"),
            F.concat(
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                line("WARC-Refers-To", F.format_string("<%s>", F.col("first.id"))),
                line("WARC-Refers-To-Target-URI", F.col("first.url")),
                line("WARC-Refers-To-Date", F.col("first.at")),
                line("X-Refers-To-Page", F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))),
            ),
        ).otherwise(""),
        line("Content-Type", F.when(F.col("kind") == "response", "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.length(block).cast("string")),
        F.lit("\r\n"),
        block.cast("string"),
    )
    both.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(warc_path)


def archived(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Write pages as ARC, convert to WARC, read back: a row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``, and the record's identifier, date and file.
    Digests and sizes of responses are taken from the payload as read. Rows that repeat a page are records of their
    own; those that share the smallest page_id are all responses. No pages give no records.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, per_file=per_file)
    arc_to_warc(spark, arc, warc, per_file)
    got = read_warc(spark, warc).where("type in ('response', 'revisit')")
    told = F.col("type") == "revisit"
    return got.select(
        F.expr("try_cast(nullif(regexp_extract(cast(head as string), '(?im)^X-Page-Id: *([^\\\\r\\\\n]*)', 1), '') as bigint)").alias("page_id"),
        F.when(told, _field("head", "Content-Length").try_cast("bigint")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(told, F.regexp_replace(F.col("fields")["warc-payload-digest"], "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(told, F.col("fields")["x-refers-to-page"].try_cast("bigint")).alias("refers_to"),
        "record_id",
        F.col("fields")["warc-date"].alias("warc_date"),
        F.col("fields")["warc-target-uri"].alias("url"),
    )


#: The same result in DuckDB's SQL.
ARCHIVED_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""
