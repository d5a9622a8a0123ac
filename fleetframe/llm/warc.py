"""WARC archives: writing captures and putting their records together again.

A capture is a request, a response (or a revisit of an earlier payload) and
a metadata record.  The request and the metadata name the response they
belong to in WARC-Concurrent-To.  Archives are written by Spark's text
writer, whose line separator ends a record, and read back record by record
by their Content-Length.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import col, shared_dir, written

END = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_FROM = 1000  # bytes of a payload worth a revisit record
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_PAGES = 2000  # captures of one archive file at most, three records each
ARCHIVE_BYTES = 1 << 27  # bytes of the payloads and urls of one archive file at most, unless it holds a single capture

RECORDS = ("type string, record_id string, concurrent_to string, target_uri string, digest string, "
           "refers_to string, http_head string, payload binary, fields map<string,string>")


def _record(kind: str, headers: list[Column], body: Column) -> Column:
    head = [F.lit("WARC/1.1" + END + f"WARC-Type: {kind}" + END + f"WARC-Date: {DATE}" + END), *headers,
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END + END))]
    return F.concat(*head, body)


def _header(name: str, value: Column) -> Column:
    """One header line; none for null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(END)), F.lit(""))


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
             revisit_from: int = REVISIT_FROM) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, owner): refers_to is the
    largest id among equal payloads of at least ``revisit_from`` bytes, null
    where that is the row's own (or there is none).  ``owner`` is the one row
    of that id, which others may name as a record; null if it repeats.

    Null payloads are empty and null urls stay null; rows that repeat are
    captures each, and of equal payloads under the largest id all refer to
    none; a null id refers to the largest of the others.  Payloads are hashed
    whole; other columns are not read; an empty table gives no rows.
    """
    body = F.coalesce(col(payload).cast("string"), F.lit(""))
    rows = pages.select(col(key).cast("bigint").alias("page_id"), col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    # Only digests that occur again: a small table, which Catalyst may broadcast by its written size.
    again = written(rows.where(F.octet_length("payload") >= revisit_from).groupBy("digest", "page_id")
                    .agg(F.count(F.lit(1)).alias("n"))
                    .groupBy(F.col("digest").alias("again"))
                    .agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("last"))
                    .where((F.col("n") > 1) & F.col("last.page_id").isNotNull())
                    .select("again", F.col("last.page_id").alias("last"), (F.col("last.n") == 1).alias("sole")))
    # Short payloads have no key: where the join shuffles, they are no digest's group.
    shared = F.when(F.octet_length("payload") >= revisit_from, F.col("digest"))
    own = F.col("page_id").eqNullSafe(F.col("last"))
    return (rows.join(again, shared == F.col("again"), "left")
            .select("page_id", "url", "payload", "digest", F.when(~own, F.col("last")).alias("refers_to"),
                    F.when(F.col("sole"), F.col("last")).alias("owner")))


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write three records for each of the ``captures`` rows.

    Record ids hold the page id and a number that makes repeated rows
    distinct; that of a payload's owner holds the digest instead, so a
    revisit can name it in WARC-Refers-To.  Payloads of a file have at most
    ``archive_bytes`` together, unless it is one alone: captures are packed
    by size class, and a class of twice the size gets half as many a file.
    """
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    named = lambda kind, page, end: F.concat(
        F.lit(f"<urn:capture:{kind}:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), end, F.lit(">"))
    mark = F.when(F.col("page_id") == F.col("owner"), F.col("digest")).otherwise(F.col("row").cast("string"))
    rid = lambda kind: named(kind, F.col("page_id"), mark)
    response, target = rid("response"), _header("WARC-Target-URI", uri)
    own = [_header("WARC-Record-ID", response), target, _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
           F.lit("Content-Type: application/http; msgtype=response" + END)]
    head = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(END + END))
    again = F.col("refers_to").isNotNull()
    main = F.when(~again, _record("response", own, F.concat(head, F.col("payload")))).otherwise(
        _record("revisit", [*own, _header("WARC-Refers-To", F.when(F.col("owner").isNotNull(), named("response", F.col("owner"), F.col("digest")))),
                            F.lit(f"WARC-Profile: {PROFILE}" + END)], head))
    request = _record("request", [
        _header("WARC-Record-ID", rid("request")), _header("WARC-Concurrent-To", response), target,
        F.lit("Content-Type: application/http; msgtype=request" + END)],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END + END)))
    metadata = _record("metadata", [
        _header("WARC-Record-ID", rid("metadata")), _header("WARC-Concurrent-To", response), target,
        F.lit("Content-Type: application/warc-fields" + END)],
        F.concat(_header("pageId", F.col("page_id")), _header("payloadLength", F.octet_length("payload")),
                 _header("refersToPage", F.col("refers_to"))))
    # A capture's size class, and a number that at most FILE_PAGES / 2^class rows of a task share.
    small = max(1, archive_bytes // FILE_PAGES)
    size = F.when(again, F.lit(0)).otherwise(F.octet_length("payload")) + F.coalesce(4 * F.octet_length(uri), F.lit(0))
    level = F.when(size <= small, F.lit(0)).otherwise(F.ceil(F.log2(size / small)).cast("int"))
    counter = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.when(level == 0, F.lit(0).cast("bigint")).otherwise(
        F.floor(counter / F.greatest(F.floor(FILE_PAGES / F.pow(F.lit(2.0), level)), F.lit(1))).cast("bigint"))
    pack = F.concat(level.cast("string"), F.lit("-"), turn.cast("string"))
    (rows.select(pack.alias("pack"), F.explode(F.array(request, main, metadata)).alias("value"))
     .write.partitionBy("pack").option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", 3 * FILE_PAGES).text(path))


def _lines(f: io.BufferedIOBase) -> dict[str, str]:
    """Header lines up to the empty one."""
    found = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive, gzip-compressed or not."""
    raw = io.BytesIO(content)
    f = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    f = io.BufferedReader(f, 1 << 20)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        h = _lines(f)
        block = f.read(int(h.get("content-length", 0)))
        http, payload, fields = None, None, {}
        if h.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
        elif h.get("content-type") == "application/warc-fields":
            fields = _lines(io.BytesIO(block))
        else:
            payload = block
        yield {"type": h.get("warc-type"), "record_id": h.get("warc-record-id"),
               "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"),
               "digest": h.get("warc-payload-digest"), "refers_to": h.get("warc-refers-to"),
               "http_head": http.decode("utf-8", "replace") if http is not None else None,
               "payload": payload, "fields": list(fields.items())}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, a row each."""
    text = pa.string()
    schema = pa.schema([(c, text) for c in ("type", "record_id", "concurrent_to", "target_uri", "digest", "refers_to",
                                               "http_head")]
                       + [("payload", pa.binary()), ("fields", pa.map_(text, text))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                some, held = [], 0
                for r in parse_archive(content.as_py()):
                    some.append(r)
                    held += len(r["payload"] or b"")
                    if held > 1 << 24 or len(some) >= 2000:
                        yield pa.RecordBatch.from_pylist(some, schema=schema)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


# What is kept of the records of each kind.
PARTS = {"response": ("type", "target_uri", "digest", "refers_to", "http_head", "payload", "payload_bytes", "payload_sha1"),
         "request": ("record_id", "target_uri", "http_head"), "metadata": ("record_id", "fields")}


def _joined(records: DataFrame) -> DataFrame:
    """A flat row per capture: its id, ``has_<kind>``, and ``<kind>_<name>``
    for the ``PARTS`` of each kind.

    Records are read once and meet in one shuffle on the response's id;
    every column is an aggregate of its own, so those that the caller does
    not use (payloads, say) do not move.
    """
    kind = (F.when(F.col("type").isin("response", "revisit"), "response")
            .when(F.col("type").isin("request", "metadata"), F.col("type")))
    refers = F.col("refers_to") if "refers_to" in records.columns else F.lit(None).cast("string")
    moved = (records.withColumn("kind", kind).withColumn("refers_to", refers)
             .withColumn("capture", F.when(F.col("kind") == "response", F.col("record_id")).otherwise(F.col("concurrent_to")))
             .where(F.col("kind").isNotNull() & F.col("capture").isNotNull())
             .withColumn("payload_bytes", F.octet_length("payload")).withColumn("payload_sha1", F.sha1("payload"))
             .withColumn("order", F.struct("record_id", "digest", "target_uri"))
             .repartition("capture"))
    aggs = [F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in PARTS]
    for k, names in PARTS.items():
        mine = F.col("kind") == k
        aggs += [F.max_by(F.when(mine, F.col(n)), F.when(mine, F.col("order"))).alias(f"{k}_{n}") for n in names]
    return moved.groupBy("capture").agg(*aggs).where("has_response")


def _nested() -> list[Column]:
    """The columns of ``assemble`` from those of ``_joined``."""
    whole = {k: F.struct(*[F.col(f"{k}_{n}").alias("id" if n == "record_id" else n) for n in names]) for k, names in PARTS.items()}
    return [F.col("capture").alias("record_id"), *[F.when(F.col(f"has_{k}"), whole[k]).alias(k) for k in PARTS]]


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata),
    joined through the concurrent-to identifiers.  ``response`` is the
    response or revisit record; a capture without request or metadata has
    null there, and a record that names no known response is left out, as is
    a response without an id, which the format forbids.  Of several records
    of a kind for one capture, that with the greatest id, digest and target.
    An empty table gives no rows.
    """
    return _joined(records).select(*_nested())


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and
    put the captures together; adds what the captures say of each page.

    Null payloads are empty, null urls have no target, null ids are kept.
    Repeated rows are captures of their own; of equal payloads under the
    largest id all rows are responses.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/fleetframe-warc-{uuid.uuid4().hex}"
    write_archives(captures(pages, key, url, payload), path)
    field = lambda name: F.col("metadata_fields")[name.lower()].cast("bigint")
    revisit = F.col("response_type") == "revisit"
    return _joined(read_records(spark, path)).select(
        *_nested(), field("pageId").alias("page_id"),
        F.when(revisit, field("payloadLength")).otherwise(F.col("response_payload_bytes").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("response_digest", "^sha1:", "")).otherwise(F.col("response_payload_sha1")).alias("payload_digest"),
        F.col("response_type").alias("record_type"), field("refersToPage").alias("refers_to"))
