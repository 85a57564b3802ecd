"""Legacy ARC archives to WARC.

An ARC file begins with a version block whose second line names the version; version 1 records have a header line of five
fields, version 2 of ten, the last being the length of what follows. Each record becomes a WARC record: an identifier
from its place and content, the date in ISO form, digests of block and payload, and the type: a response, or a revisit of
the first record with the same payload.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.stage import new_folder, staged

#: Payloads below this many bytes are never a revisit.
LEAST = 100
#: Bytes of one ARC archive, and of one WARC file, about.
ARCHIVE = 1 << 22
FILE = 1 << 25
PAGE_HEADER = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: The header lines of both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "record_id string, uri string, ip string, warc_date string, http binary, payload binary, block_digest string, payload_digest string, payload_bytes bigint, page string"
READ = "page string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


def arc_version_block(version: int, name: str, date: str = "20200101000000") -> bytes:
    body = f"{version} {0 if version == 1 else 1} corpus\n{FIELDS[version]}\n\n".encode()
    blank = {1: "text/plain", 2: "text/plain 200 - - 0 " + name}[version]
    return f"filedesc://{name} 0.0.0.0 {date} {blank} {len(body)}\n".encode() + body


def arc_record(version: int, uri: str, date: str, body: bytes, offset: int, name: str) -> bytes:
    """A record; white space and controls in the address are percent-encoded, an empty address is a hyphen."""
    address = quote(uri, safe="%/:?#[]@!$&'()*+,;=~._-|") or "-"
    middle = "text/html" if version == 1 else f"text/html 200 {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{address} 0.0.0.0 {date} {middle} {len(body)}\n".encode() + body + b"\n"


class Record(NamedTuple):
    version: int
    uri: str
    ip: str
    date: str
    body: bytes
    offset: int


def arc_records(data: bytes) -> Iterator[Record]:
    """The records behind the version block, by their declared lengths; a line that is no header is an error."""
    at, version, first = 0, 0, True
    while at < len(data):
        if data[at] == 10:
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"the record at {at} ends before its declared length")
        if first:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("an archive begins with a version block")
            version, first = int(body[: body.index(b" ")]), False
        else:
            if len(fields) != {1: 5, 2: 10}[version]:
                raise ValueError(f"the header line at {at} has {len(fields)} fields")
            yield Record(version, fields[0], fields[1], fields[2], body, at)
        at = end + 1 + length


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def header_value(http: bytes, name: str) -> str | None:
    for line in http.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower().encode():
            return value.strip().decode()
    return None


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line, and the payload; a body without a header is all payload."""
    cut = body.find(b"\r\n\r\n")
    return (body[: cut + 4], body[cut + 4 :]) if body.startswith(b"HTTP/") and cut >= 0 else (b"", body)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", size: int = ARCHIVE) -> DataFrame:
    """``archive``: ARC files, of both versions in turn, that hold a response for every page; null html is empty."""
    rows = pages.select(F.col(key).cast("string"), F.coalesce(url, F.lit("")), F.coalesce(html, F.lit("")).cast("binary"))

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made, length = 0, [], 0
        for part in parts:
            for page, uri, body in zip(*part.columns, strict=True):
                page = page.as_py()
                if not made:
                    number += 1
                    version, name = 1 + number % 2, f"pages-{number:06d}.arc"
                    made = [arc_version_block(version, name)]
                    length = len(made[0])
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{PAGE_HEADER}: {page}\r\n" if page is not None else "") + "\r\n"
                made.append(arc_record(version, uri.as_py(), "20200101000000", http.encode() + body.as_py(), length, name))
                length += len(made[-1])
                if length >= size:
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})
                    made = []
        if made:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(made)], pa.binary())})

    return rows.mapInArrow(per_batch, "archive binary")


def converted(arcs: DataFrame) -> DataFrame:
    """The records of ARC files (column ``archive``) with WARC identifiers, dates and digests."""

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for archive in part.column(0):
                data, out = archive.as_py(), {name.split(" ")[0]: [] for name in RECORD.split(", ")}
                for r in arc_records(data):
                    http, payload = split_http(r.body)
                    block = digest(r.body)
                    named = uuid.uuid5(uuid.NAMESPACE_URL, f"{r.uri} {r.date} {r.offset} {block}")
                    page = header_value(http, PAGE_HEADER)
                    values = (f"urn:uuid:{named}", r.uri, r.ip, iso_date(r.date), http, payload, block, digest(payload), len(payload), page)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                if out["uri"]:
                    types = [pa.int64() if "bigint" in t else pa.binary() if "binary" in t else pa.string() for t in RECORD.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return arcs.mapInArrow(per_batch, RECORD)


def typed(records: DataFrame, firsts: DataFrame) -> DataFrame:
    """The records with ``first``, the page whose response they revisit, null for responses."""
    same = records.join(firsts, "payload_digest", "left")
    first = F.when(F.col("page").cast("bigint") > F.col("least"), F.col("least"))
    return same.withColumn("first", first.cast("string"))


def firsts(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``payload_digest, least, least_record``: the smallest page of every payload that comes more than once.

    Partial aggregation meets a payload that a third of all pages share before the shuffle does.
    """
    page = F.col("page").cast("bigint")
    same = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
    return same.agg(F.count(F.lit(1)).alias("n"), F.min(page).alias("least"), F.min_by("record_id", page).alias("least_record")).where(
        "n > 1"
    ).drop("n")


def warc_text() -> Column:
    """A record as text, without the end that the writer puts between lines. Bytes that are no UTF-8 pass unchanged."""
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.col("http").cast("string")
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Date", F.col("warc_date")),
        F.when(revisit, F.lit("")).otherwise(line("WARC-Block-Digest", F.col("block_digest"))),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        # An extension field: a revisit's own length does not tell its payload's.
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<"), "least_record", F.lit(">"))),
                line("WARC-Refers-To-Page", F.col("first")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")),
    )


def written(arcs: DataFrame, folder: str, least: int = LEAST, size: int = FILE) -> None:
    """Convert ARC files and write them as gzipped WARC files of about ``size`` bytes of content.

    A first pass keeps digests only, to find which payloads come again; then every record is dealt by its digest once.
    A payload's copies are joined with one row, which the skew join can cut, and what is written is spread by number.
    """
    records = converted(arcs)
    narrow = staged(records.select("payload_digest", "payload_bytes", "page", "record_id"), "digests")
    again = staged(firsts(narrow, least), "firsts")
    rows = typed(records, again).select(warc_text().alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(folder)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record, by declared length."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        yield fields, data[cut + 4 : cut + 4 + length]
        at = cut + 4 + length + len(END)


def read_back(spark, folder: str) -> DataFrame:
    """What the WARC files in ``folder`` say of every record; digests of responses are computed from their payload."""
    files = spark.read.format("binaryFile").load(folder).select("content")

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0):
                rows = []
                for fields, block in warc_records(gzip.decompress(content.as_py())):
                    http, payload = split_http(block)
                    kind = fields["WARC-Type"]
                    own = kind == "response"
                    found = digest(payload) if own else fields["WARC-Payload-Digest"]
                    if found != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
                    count = len(payload) if own else int(fields["WARC-Payload-Length"])
                    rows.append((header_value(http, PAGE_HEADER), kind, count, found.partition(":")[2], fields.get("WARC-Refers-To-Page")))
                if rows:
                    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    names = [x.split(" ")[0] for x in READ.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(per_batch, READ)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` of every page, read back from WARC files.

    Pages whose html is equal and at least LEAST bytes long: that with the smallest key is the response, the others
    revisit it; rows that repeat that smallest key are responses too, and so are rows with a null key. Null html is
    empty. Other columns are not read. An empty table gives no rows. The files stay in the checkpoint folder.
    """
    spark, folder = pages.sparkSession, new_folder(pages.sparkSession, "warc")
    written(archives(pages, key, url, html), folder)
    kind = pages.schema[key].dataType
    return read_back(spark, folder).select(
        F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def oracle() -> str:
    """DuckDB SQL for the query over ``pages``."""
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= {LEAST} GROUP BY d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
           CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > least THEN least END AS refers_to
    FROM p LEFT JOIN f USING (d)"""
