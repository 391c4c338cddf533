"""WARC archives: writing captures, reading records and assembling transactions.

A capture is three records: the response (or a revisit of an earlier one with the same
payload), its request and its metadata; the latter two name the first one in
``WARC-Concurrent-To``. Records are built as SQL expressions and written by Spark's text
writer, whose line separator is the blank line that ends a record; a file never holds more than
``FILE_RECORDS`` records. Archives are read whole-file as binary and cut by the lengths that
their records state, so payloads may hold any bytes. Transactions are joined through the
concurrent-to identifiers and come out as one nested row per capture.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneloom.session import stage_path, stage_table

FILE_RECORDS = 3000
_COPIES = 1 << 16
VERSION = "WARC/1.1"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LINE = "\r\n"
_DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a record becomes when it is read.
RECORD = ("record_id string, record_type string, target_uri string, concurrent_to array<string>, "
          "refers_to string, payload_digest string, payload_bytes bigint, content_type string, "
          "fields map<string,string>, payload binary, archive string")
_SCHEMA = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("content_type", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
    ("payload", pa.binary()), ("archive", pa.string())])


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1,
                                F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(kind: str, key: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{kind}:"), key))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(digest, at, n) for at, n in cuts]), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without the blank line at its end; headers with a null value are left out."""
    lines = [F.lit(f"{VERSION}{_LINE}WARC-Type: {kind}{_LINE}")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_LINE)), F.lit("")))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"),
                          F.lit(_LINE + _LINE)))
    return F.concat(*[x.cast("binary") for x in lines], block).cast("string")


def _one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def write_captures(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a WARC capture per row ``page_id, url, html`` as gzip archives below ``path``.

    Among equal payloads of at least ``least`` bytes the one with the smallest page_id (null
    last, then the smallest url) is the response and the others revisit it; smaller ones are
    all responses. A null html is an empty payload, a null url leaves the target out. Rows that
    repeat page_id, url and html are one capture, whose records are written for each of them. The first of a payload is found with a
    combined aggregate that is written before it is joined, so a payload that very many pages
    share is split by Spark.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    rows = pages.select("page_id", page.alias("page"), _one_line(F.col("url")).alias("uri"),
                        payload.alias("payload"), sha1_base32(payload).alias("digest"))
    key = F.concat_ws("|", "page", F.coalesce("uri", F.lit("")), "digest")
    rows = rows.withColumn("id", _uuid("response", key))
    first = (rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "uri", "id")).alias("first")))
    first = stage_table(first.select(F.col("digest").alias("_digest"), F.col("first.id").alias("of"),
                                     F.col("first.uri").alias("of_uri")), "payloads")
    rows = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}"
              "Content-Length: "), F.octet_length("payload").cast("string"),
        F.lit(_LINE + _LINE)).cast("binary")
    common = [("WARC-Target-URI", F.col("uri")), ("WARC-Date", _DATE)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    message = ("Content-Type", "application/http;msgtype=response")
    response = _record("response", [("WARC-Record-ID", F.col("id")), *common, digest, message],
                       F.concat(http, F.col("payload")))
    revisit = _record("revisit", [
        ("WARC-Record-ID", F.col("id")), *common, digest, ("WARC-Profile", _REVISIT),
        ("WARC-Refers-To", F.col("of")), ("WARC-Refers-To-Target-URI", F.col("of_uri")),
        message], http)
    host = F.coalesce(F.try_parse_url(F.col("uri"), F.lit("HOST")), F.lit(""))
    request = _record("request", [
        ("WARC-Record-ID", _uuid("request", F.col("id"))), *common,
        ("WARC-Concurrent-To", F.col("id")),
        ("Content-Type", "application/http;msgtype=request")],
        F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{_LINE}Host: "),
                 host, F.lit(_LINE + _LINE)).cast("binary"))
    metadata = _record("metadata", [
        ("WARC-Record-ID", _uuid("metadata", F.col("id"))), *common,
        ("WARC-Concurrent-To", F.col("id")), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.col("page"), F.lit(_LINE)).cast("binary"))
    again = F.coalesce(F.col("of") != F.col("id"), F.lit(False))
    records = rows.select(F.explode(F.array(
        F.when(again, revisit).otherwise(response), request, metadata)).alias("value"))
    (records.write.option("lineSep", _LINE + _LINE).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def _unzip(data: bytes) -> bytes:
    """All members of a gzip archive; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out) if out else data


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines if b":" in line)
    return [(name.strip().lower(), value.strip()) for name, _, value in pairs]


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, cut by the lengths they state. Raises on a broken one."""
    at = 0
    while True:
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].split(b"\r\n") if end >= 0 else [b""]
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        pairs = _fields(head[1:])
        known = dict(reversed(pairs))
        length = int(known["content-length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length:
            raise ValueError(f"the record at byte {at} is cut off")
        at = end + 4 + length
        yield known | {"concurrent": [v for k, v in pairs if k == "warc-concurrent-to"],
                       "block": block}


def _entry(record: dict, archive: str, payloads: bool) -> dict:
    block, kind = record["block"], record.get("warc-type")
    fields, payload, size = [], block, None
    if record.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(head.split(b"\r\n")[1:])
    elif record.get("content-type", "").startswith("application/warc-fields"):
        fields = _fields(block.split(b"\r\n"))
    size = len(payload)
    if kind == "revisit":  # the payload itself is in the record it refers to
        size = int(dict(fields).get("content-length", 0))
    digest = record.get("warc-payload-digest")
    return {"record_id": record.get("warc-record-id"), "record_type": kind,
            "target_uri": record.get("warc-target-uri"), "concurrent_to": record["concurrent"],
            "refers_to": record.get("warc-refers-to"),
            "payload_digest": digest.partition(":")[2] if digest else None,
            "payload_bytes": size, "content_type": record.get("content-type"),
            "fields": list(dict(fields).items()), "payload": payload if payloads else None,
            "archive": archive}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, gzip or plain, in the columns of RECORD.

    ``payloads=False`` leaves the payloads out after their size has been taken. The length of a
    revisit's payload is the one its HTTP header states. No archives give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                archive = batch.column("path")[i].as_py()
                held, rows = 0, []
                for record in parse_archive(_unzip(batch.column("content")[i].as_py())):
                    rows.append(_entry(record, archive, payloads))
                    held += len(record["block"]) if payloads else 256
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        held, rows = 0, []
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("path", "content"))
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, response, request, metadata`` and counts.

    A request or metadata record belongs to the response or revisit that it is concurrent to,
    or that names it as concurrent. Where several of a kind belong to one capture, the row
    holds the one with the smallest id, and ``requests``/``metadata_records`` their number.
    Captures without one have a null there. Records that repeat an id are
    one, and ``copies`` tells how often the capture's record was read; records without an id,
    and those that belong to no capture, do not come out.
    """
    rows = records.where("record_id IS NOT NULL").groupBy("record_id").agg(
        *[F.first(c).alias(c) for c in records.columns if c != "record_id"],
        F.count("*").alias("copies"))
    rows = stage_table(rows, "records")
    main = rows.where("record_type IN ('response', 'revisit')")
    side = rows.where("record_type IN ('request', 'metadata')")
    body = F.struct(*[c for c in records.columns if c not in ("concurrent_to",)])
    named = side.select(F.col("record_id").alias("side_id"),
                        F.explode("concurrent_to").alias("main_id"))
    back = main.select(F.explode("concurrent_to").alias("side_id"),
                       F.col("record_id").alias("main_id"))
    links = named.unionByName(back).distinct()
    bodies = side.select(F.col("record_id").alias("side_id"), "record_type",
                         F.struct(F.col("record_id").alias("id"), F.struct(
                             "record_id", "target_uri", "content_type", F.map_entries("fields")
                             .alias("fields"), "payload_bytes", "payload").alias("body")).alias("body"))
    parts = stage_table(
        links.join(bodies, "side_id").groupBy("main_id").agg(*[
            x for kind in ("request", "metadata") for x in (
                F.min(F.when(F.col("record_type") == kind, F.col("body"))).alias(f"of_{kind}"),
                F.count(F.when(F.col("record_type") == kind, 1)).alias(f"n_{kind}"))]),
        "concurrent")

    def part(kind: str) -> Column:
        found = F.col(f"of_{kind}")["body"]
        return F.when(found.isNotNull(), found.withField(
            "fields", F.map_from_entries(found["fields"])))

    return (main.select("record_id", body.alias("response"), "copies")
            .join(parts, F.col("record_id") == F.col("main_id"), "left")
            .select("record_id", "response", part("request").alias("request"),
                    part("metadata").alias("metadata"),
                    F.coalesce("n_request", F.lit(0)).alias("requests"),
                    F.coalesce("n_metadata", F.lit(0)).alias("metadata_records"), "copies"))


def page_captures(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of assembled captures
    whose metadata name a page, a row for each of their records; ``refers_to`` is the page of the
    response revisited."""
    rows = stage_table(captures.select(
        "record_id", F.expr("try_cast(metadata.fields['page-id'] AS bigint)").alias("page_id"),
        "response.payload_bytes", "response.payload_digest", "response.record_type",
        F.col("response.refers_to").alias("_refers"), "copies"), "captures")
    first = stage_table(
        rows.where("_refers IS NOT NULL").select(F.col("_refers").alias("record_id")).distinct()
        .join(rows.select("record_id", F.col("page_id").alias("refers_to")), "record_id")
        .withColumnRenamed("record_id", "_first"), "revisited")
    # in two steps, so that no array is long
    more = F.expr(f"copies - {_COPIES} * part").cast("int")
    return (rows.join(first, F.col("_refers") == F.col("_first"), "left")
            .withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_COPIES})")))
            .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(more, F.lit(_COPIES)))))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and assemble."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_captures(pages, path)
    return page_captures(assemble(read_records(spark, path, payloads=False)))
