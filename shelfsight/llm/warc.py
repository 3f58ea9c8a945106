"""WARC archives: writing page captures, reading records back, assembling transactions.

A capture is three records: the request, the response (or a revisit of an equal
payload) and a metadata record. Request and metadata name their capture in
WARC-Concurrent-To. Records are text in UTF-8, so Spark's text writer makes the
archive: the record separator of the format is its line separator, and a file is
one gzip stream. Reading goes by Content-Length, as payloads may contain anything, separators included.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm.common import whole_text
from shelfsight.session import shared_folder

CRLF = "\r\n"
FILE_BYTES = 8 << 20
# fixed values: the alphabet of RFC 4648
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_id string, record_type string, concurrent_to string, warc_date string, target_uri string, "
    "payload_digest string, headers map<string,string>, fields map<string,string>, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits (five hex digits) make four characters."""
    digest = F.sha1(data)
    letters = F.array(*[F.lit(x) for x in BASE32])
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.get(letters, F.shiftright(bits, s).bitwiseAND(31)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    """One header line; none for null. Control characters and blanks would end it early and are escaped."""
    clean = F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record(kind: str | Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}"), _header("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [_header("WARC-Record-ID", record_id), *[_header(k, v) for k, v in headers]]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF)))
    return F.concat(*lines, block)


def write_captures(
    pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html",
    captured_at: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write every row of ``pages`` as a capture of three records below ``path``.

    Payload: the html in UTF-8, null as empty. Among equal payloads of at least
    ``min_bytes`` bytes the smallest page_id is the response and the others are
    revisits; smaller payloads are responses. Rows that share that smallest id
    are responses too; a null id is larger than all others. A null address
    gives a record without target. Equal payloads are found by digest and length,
    counted before the shuffle. Other columns are ignored.
    """
    payload = whole_text(F.col(html))
    rows = pages.select(
        F.col(page_id).alias("_page"), F.col(url).alias("_url"), payload.alias("_html"),
        F.octet_length(payload).cast("long").alias("_bytes"), base32_sha1(F.encode(payload, "UTF-8")).alias("_digest"),
    )
    first = rows.filter(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(
        F.min(F.col("_page")).alias("_first"), F.count("*").alias("_n")
    )
    # only digests that occur more than once matter below
    first = first.filter("_n > 1").drop("_n").withColumnRenamed("_digest", "_d")
    rows = rows.join(first, F.col("_digest") == F.col("_d"), "left").drop("_d")
    revisit = F.coalesce(~F.col("_page").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    rows = rows.withColumn("_revisit", revisit).select("*", F.explode(F.array(F.expr("uuid()"))).alias("_u"))
    rid = lambda kind: F.concat(F.lit("<urn:uuid:"), F.col("_u"), F.lit(f":{kind}>" if kind else ">"))
    shared = [("WARC-Date", F.lit(captured_at)), ("WARC-Target-URI", F.col("_url"))]
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    response = _record(
        F.when(F.col("_revisit"), "revisit").otherwise("response"),
        rid(""),
        [
            *shared,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
            ("WARC-Profile", F.when(F.col("_revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(head, F.when(F.col("_revisit"), "").otherwise(F.col("_html"))),
    )
    request = _record(
        "request", rid("request"),
        [("WARC-Concurrent-To", rid("")), *shared, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("_url", r"[\x00-\x20\x7F]", "%20"), F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}")),
    )
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))
    metadata = _record(
        "metadata", rid("metadata"),
        [("WARC-Concurrent-To", rid("")), *shared, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(
            field("pageId", F.col("_page")), field("payloadBytes", F.col("_bytes")),
            field("refersToPage", F.when(F.col("_revisit"), F.col("_first"))),
        ),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # no shuffle after uuid(): the records of a capture come from one task, also when that task runs again
    size = pages.agg(F.avg(F.octet_length(whole_text(F.col(html))) + 1500)).first()[0] or 1500
    per_file = 3 * max(1, int(FILE_BYTES / size))
    records.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).text(path, compression="gzip")


def _fields(lines: list[str]) -> dict[str, str]:
    """Named fields, the last of a name; lines without a colon are left out."""
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {name: value.strip() for name, value in pairs}


def _parse(data: bytes) -> Iterator[dict]:
    """Records of one archive. Only Content-Length says where a block ends."""
    at = data.find(b"WARC/")
    while 0 <= at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = _fields(data[at:end].decode("utf-8", "replace").split(CRLF)[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        block = data[start:stop]
        kind = headers["WARC-Type"]
        payload, digest = block, headers.get("WARC-Payload-Digest")
        if kind in ("response", "revisit"):
            payload = block[block.index(b"\r\n\r\n") + 4:]
        if kind == "response":
            made = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest is not None and digest != made:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
            digest = made
        yield {
            "record_id": headers["WARC-Record-ID"], "record_type": kind, "concurrent_to": headers.get("WARC-Concurrent-To"),
            "warc_date": headers.get("WARC-Date"), "target_uri": headers.get("WARC-Target-URI"),
            "payload_digest": digest.removeprefix("sha1:") if digest else None,
            "headers": list(headers.items()),
            "fields": list(_fields(block.decode("utf-8", "replace").split(CRLF)).items()) if kind == "metadata" else [],
            "payload": payload,
        }
        at = data.find(b"WARC/", stop)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, plain or gzip, below ``path``; response payloads are checked against their digests.

    payload: the body of an HTTP response, else the whole block. An archive is
    read whole by one task, so writers keep files small. A payload that does not
    match its digest fails the read. An empty archive has no records.
    """
    kinds = {
        "record_id": pa.string(), "record_type": pa.string(), "concurrent_to": pa.string(), "warc_date": pa.string(),
        "target_uri": pa.string(), "payload_digest": pa.string(), "headers": pa.map_(pa.string(), pa.string()),
        "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary(),
    }
    schema = pa.schema(list(kinds.items()))

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                packed = data.as_py()
                for record in _parse(gzip.decompress(packed) if packed[:2] == b"\x1f\x8b" else packed):
                    held.append(record)
                    size += len(record["payload"])
                    if len(held) >= 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORDS)


def assemble_captures(records: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    The capture of a response, revisit or resource is its own record id, that of
    a request or metadata record the id it is concurrent to. Records are grouped
    by capture; ``requests`` and ``metadata`` are arrays in record-id order, empty
    when missing. Records that point to an absent response give a row with a null
    ``response``; a record without any link is its own capture. Of several
    responses with one id the first by digest counts. Metadata blocks are read as
    named fields. ``keep_payload=False`` leaves the
    response's payload out, and it is then not shuffled.
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    own = ["record_id", "record_type", "warc_date", "target_uri", "payload_digest", "headers"]
    body = [F.col("payload")] if keep_payload else []
    keyed = records.select(
        F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id"),
        F.when(main, F.struct("payload_digest", *[c for c in own if c not in ("payload_digest", "headers")], *body)).alias("response"),
        F.when(F.col("record_type") == "request", F.struct("record_id", "warc_date", "target_uri", F.col("payload").cast("string").alias("block"))).alias("request"),
        F.when(F.col("record_type") == "metadata", F.struct("record_id", "warc_date", "fields")).alias("meta"),
    )
    by_id = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    return keyed.groupBy("capture_id").agg(
        F.min("response").alias("response"),
        F.array_sort(F.collect_list("request"), by_id).alias("requests"),
        F.array_sort(F.collect_list("meta"), by_id).alias("metadata"),
    )


def capture_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as captures to a fresh shared folder, read them back and assemble them."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_captures(pages, path, min_bytes)
    return assemble_captures(read_records(spark, path), keep_payload=False)
