"""Legacy archive converter: ARC files of version 1 and 2 to WARC.

An ARC file opens with a version block that names the fields of its header lines; each record is one
header line, whose last field declares the length, and so many bytes. The converter reads those, and
writes WARC records with synthesised identifiers, timestamps, types and digests. Archives are written by
Spark's own text writer (gzip; the lines between records are part of both formats), so they land wherever
Spark can write, and are read as whole files, each of a bounded number of records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.session import cut, scratch_dir

RECORDS_PER_FILE = 2_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
# fixed values: the field lines of the two versions' version blocks
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_END = "\r\n\r\n"

RECORD = ("record_id string, url string, ip string, date string, record_type string, refers_to_id string, "
          "payload_digest string, http string, payload_bytes bigint, payload string")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------

def arc_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One ARC record per page as text (``version``, ``value``): even ids version 1, odd ids version 2.

    The HTTP head keeps the page's id in ``X-Page-Id`` (empty for null) and the length of the body; a
    null body is empty, a null URL is ``-``, and blanks in URLs are percent-coded, since blanks part fields.
    """
    text = F.coalesce(F.col(body), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "),
                    F.coalesce(F.col(page_id).cast("string"), F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit(WARC_END))
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(page_id) % 31_536_000, F.lit(0))),
                         "yyyyMMddHHmmss")
    where = F.regexp_replace(F.coalesce(F.nullif(F.col(url), F.lit("")), F.lit("-")), r"[\x00-\x20]", "%20")
    length = (F.octet_length(head) + F.octet_length(text)).cast("string")
    version = F.when(F.col(page_id) % 2 == 1, 2).otherwise(1)
    fields = {1: [where, F.lit("0.0.0.0"), date, F.lit("text/html"), length],
              2: [where, F.lit("0.0.0.0"), date, F.lit("text/html"), F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"),
                  F.lit("-"), length]}
    line = F.when(F.col(page_id) % 2 == 1, F.concat_ws(" ", *fields[2])).otherwise(F.concat_ws(" ", *fields[1]))
    return pages.select(version.alias("version"), F.concat(line, F.lit("\n"), head, text).alias("value"))


def version_block(version: int) -> str:
    body = f"{version} 0 linkspark\n{FIELDS[version]}\n"
    return f"filedesc://part.arc 0.0.0.0 20240101000000 text/plain {len(body)}\n{body}"


def write_arc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """ARC files of at most ``per_file`` records each, below ``version=1`` and ``version=2``.

    The writer of a file knows no file header, so a version block stands before every record's line as
    often as the task starts a new file could; readers accept a version block anywhere.
    """
    for version in FIELDS:
        own = records.filter(F.col("version") == version)
        block = F.lit(version_block(version) + "\n")
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) % per_file == 0
        (own.select(F.when(first, F.concat(block, "value")).otherwise(F.col("value")).alias("value"))
         .write.option("maxRecordsPerFile", per_file).option("compression", "gzip").option("lineSep", "\n")
         .text(f"{path}/version={version}"))


def parse_arc(data: bytes) -> Iterator[dict]:
    """Header fields (by name) and ``block`` of every record; the field line of the last version block holds."""
    at, names = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode().split(" ")
        length = int(values[-1])
        block = data[end + 1:end + 1 + length]
        if len(block) < length:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + length
        if values[0].startswith("filedesc://"):
            names = block.decode().split("\n")[1].split(" ")
            continue
        if names is None or len(names) != len(values):
            raise ValueError("an ARC header line doesn't have the fields of its version")
        yield dict(zip(names, values)) | {"block": block}


def _unzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow("page_id", "record_id", "url", "ip", "date", "payload_digest", "http", "payload_bytes", "payload")
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows, held = [], 0
            for n, arc in enumerate(parse_arc(_unzip(content.as_py()))):
                http, _, payload = arc["block"].partition(WARC_END.encode())
                d = arc["Archive-date"]
                head = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                rows.append({
                    "page_id": int(head["X-Page-Id"]) if head.get("X-Page-Id") else None,
                    "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{path}#{n}')}>",
                    "url": arc["URL"], "ip": arc["IP-address"],
                    "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                    "payload_digest": payload_digest(payload), "http": http.decode(),
                    "payload_bytes": len(payload), "payload": payload.decode()})
                held += len(payload)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def _arrow(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n in names])


def read_arc(spark, path: str) -> DataFrame:
    """The records of ARC files as WARC fields, ``page_id`` from the HTTP head; one file at a time per task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_converted, "page_id bigint, record_id string, url string, ip string, date string, "
                            "payload_digest string, http string, payload_bytes bigint, payload string")


# --- WARC --------------------------------------------------------------------------------------------

def with_types(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``record_type`` and ``refers_to_id``.

    Of records with equal payloads of at least ``min_bytes`` the one with the smallest (page_id, record_id)
    is the response (a null page_id comes last), the others are revisits of it. Decided on digests alone;
    only digests that occur twice or more are looked up again.
    """
    big = records.filter(F.col("payload_bytes") >= min_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first")
    groups = (big.groupBy("payload_digest").agg(first, F.count("*").alias("n")).filter("n > 1")
              .select("payload_digest", F.col("first.record_id").alias("first_id")))
    joined = records.join(cut(groups), "payload_digest", "left")
    again = (F.col("payload_bytes") >= min_bytes) & (F.col("record_id") != F.col("first_id"))
    again = F.coalesce(again, F.lit(False))
    return joined.select("*", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first_id")).alias("refers_to_id")).drop("first_id")


def warc_text(records: DataFrame) -> DataFrame:
    """Each record as a WARC/1.1 record without its closing blank lines; revisits keep the HTTP head only."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.col("http"), F.lit(WARC_END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return records.select(F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 line("WARC-Refers-To", F.col("refers_to_id")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("value"))


def write_warc(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    (warc_text(records).write.option("maxRecordsPerFile", per_file).option("compression", "gzip")
     .option("lineSep", WARC_END).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of every record, cut by the declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC version line where a record should start")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record isn't as long as it declares")
        yield head, data[end + 4:stop]
        at = stop + 4


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow("page_id", "record_id", "refers_to_id", "record_type", "payload_bytes", "payload_digest")
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in parse_warc(_unzip(content.as_py())):
                http, _, payload = block.partition(WARC_END.encode())
                fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and digest != payload_digest(payload):
                    raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                rows.append({
                    "page_id": int(fields["X-Page-Id"]) if fields.get("X-Page-Id") else None,
                    "record_id": head["WARC-Record-ID"], "refers_to_id": head.get("WARC-Refers-To"),
                    "record_type": head["WARC-Type"], "payload_digest": digest,
                    "payload_bytes": int(fields["Content-Length"])})
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, record_id, refers_to_id, record_type, payload_bytes, payload_digest) per record; checks digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read_back, "page_id bigint, record_id string, refers_to_id string, record_type string, "
                            "payload_bytes bigint, payload_digest string")


def convert(spark, arc: str, warc: str, min_bytes: int = 0) -> None:
    """Convert the ARC files below ``arc`` into WARC files below ``warc``."""
    write_warc(with_types(cut(read_arc(spark, arc)), min_bytes), warc)


def pages_through_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as ARC, convert, read the WARC files back; one row per page.

    ``refers_to`` is the page_id of the response that a revisit names. Repeated rows are records of their
    own: all but the first revisit it. An empty table gives no rows. Other columns are not read.
    """
    spark, folder = pages.sparkSession, f"{scratch_dir(pages.sparkSession).rstrip('/')}/archives/{uuid.uuid4().hex}"
    write_arc(arc_records(pages), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", min_bytes)
    back = cut(read_warc(spark, f"{folder}/warc"))
    # a response refers to nothing and stays out of the join: null keys would all meet in one task
    responses = back.filter("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = back.filter("record_type = 'revisit'").join(named, "refers_to_id")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(cols).unionByName(revisits.select(cols))
