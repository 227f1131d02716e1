"""WARC archives: write one transaction a page, read the files back, join the records of each transaction.

A page makes three records: ``request``, ``response`` (or ``revisit``, where the same payload has a smaller page id)
and ``metadata``. The request and the metadata name the response in WARC-Concurrent-To, a revisit names its original
in WARC-Refers-To. A WARC record ends with two line ends, so Spark's text writer with that separator makes real
(gzipped) WARC files. Reading goes by Content-Length, so payloads may contain anything.

Null html is the empty payload. Of repeated rows (same page_id, same payload) one is the response, if any. Payloads of
fewer than min_revisit bytes are never revisits. A table without pages gives no captures. A third of the pages may
share one payload: the original of a payload is found by a partial aggregation and joined to written tables, whose
hot partitions adaptive execution splits.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import as_batch, pieces, scratch, written

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES, MOST_RECORDS = 64 << 20, 20_000  # a file holds about so many bytes of records, and never more than so many records
HEAD_BYTES = 1_500  # a page's three records without its payload, about
RECORDS = "type string, record_id string, concurrent_to string, refers_to string, uri string, page_id long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str, copy: int, kind: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{digest}/{copy}').urn}>"


def record(kind: str, fields: dict[str, str | None], block: bytes) -> str:
    head = {"WARC-Type": kind, **fields, "WARC-Date": DATE, "Content-Length": str(len(block))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n" + block.decode()


def transaction(page_id: int | None, copy: int, url: str, payload: bytes, original: tuple[int | None, int] | None) -> list[str]:
    """The three records of a capture; original: (page id, copy) of the response that a revisit points to."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = record_id(page_id, digest, copy, "response")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": own, "WARC-Target-URI": url, "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": "sha1:" + digest,
    }
    if original:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(original[0], digest, original[1], "response")}
    ask = {"WARC-Record-ID": record_id(page_id, digest, copy, "request"), "WARC-Target-URI": url, "WARC-Concurrent-To": own, "Content-Type": "application/http;msgtype=request"}
    about = {"WARC-Record-ID": record_id(page_id, digest, copy, "metadata"), "WARC-Target-URI": url, "WARC-Concurrent-To": own, "Content-Type": "application/warc-fields"}
    return [
        record("request", ask, b"GET / HTTP/1.1\r\nAccept: text/html\r\n\r\n"),
        record("revisit" if original else "response", fields, http + (b"" if original else payload)),
        record("metadata", about, b"" if page_id is None else f"page-id: {page_id}\r\n".encode()),
    ]


def write_archives(pages: DataFrame, min_revisit: int = 0) -> str:
    """Writes the archives of pages (page_id, url, html) to the shared folder; returns their path."""
    spark = pages.sparkSession
    pages = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "coalesce(cast(html as string), '') html")
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    pages = pages.withColumn("capture", F.concat_ws("/", "digest", "page_id"))  # never null, so join and window share one exchange
    slim = written(pages.groupBy("capture", "page_id", "digest").agg(F.max(F.octet_length("html")).alias("size")), "warc-pages")
    firsts = written(slim.groupBy("digest").agg(F.min("page_id").alias("first")), "warc-firsts")
    verdicts = written(slim.join(firsts, "digest", "left").where(f"size >= {int(min_revisit)}").selectExpr("capture", "digest as payload", "first"), "warc-verdicts")
    mean = slim.agg(F.coalesce(F.avg("size"), F.lit(0.0))).first()[0] + HEAD_BYTES
    records_a_file = max(3, min(MOST_RECORDS, int(3 * FILE_BYTES / mean)))
    joined = pages.join(verdicts, "capture", "left")
    joined = joined.withColumn("copy", F.row_number().over(Window.partitionBy("capture").orderBy("url")) - 1)

    def run(batches):
        for batch in pieces(batches, "html"):
            out: list[str] = []
            for r in batch.to_pylist():
                again = r["payload"] is not None and (r["page_id"] != r["first"] or r["copy"] > 0)
                clean = " ".join((r["url"] or "").split())
                out += transaction(r["page_id"], r["copy"], clean, r["html"].encode(), (r["first"], 0) if again else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    path = scratch(spark, "warc-archives")
    lines = joined.select("page_id", "url", "html", "payload", "first", "copy").mapInArrow(run, "value string")
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    return path


def unzipped(content: bytes, step: int = 1 << 20):
    """The bytes of a gzip file of one or more members, a part at a time."""
    while content:
        z = zlib.decompressobj(31)
        while not z.eof:
            part = z.decompress(content, step)
            content = z.unconsumed_tail or z.unused_data
            if part:
                yield part
            elif not content and not z.eof:
                raise ValueError("the archive ends within a record")


def parse(parts) -> "iter":
    """(headers, block) of every record in the stream of bytes."""
    parts, held = iter(parts), bytearray()

    def fill() -> bool:
        more = next(parts, None)
        if more is None:
            return False
        held.extend(more)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = held[:at].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = at + 4 + int(headers["content-length"])
        while len(held) < end + 4:
            if not fill():
                raise ValueError("the archive ends within a block")
        yield headers, bytes(held[at + 4 : end])
        del held[: end + 4]


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under path; the payload itself only if asked for."""

    def run(batches):
        schema = pa.schema([("type", pa.string()), *((n, pa.string()) for n in ("record_id", "concurrent_to", "refers_to", "uri")), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for h, block in parse(unzipped(content.as_py())):
                    kind, page, size, digest, payload = h["warc-type"], None, None, None, None
                    if kind == "metadata":
                        page = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
                    elif kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        size = len(payload)
                        if kind == "revisit":  # holds the headers of the full payload
                            size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {h['warc-record-id']} is damaged")
                        held += len(payload) * with_payload
                    rows.append((kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), page, size, digest, payload if with_payload else None))
                    if len(rows) >= 5000 or held >= 4 << 20:
                        yield as_batch(schema, *map(list, zip(*rows, strict=True)))
                        rows, held = [], 0
                if rows:
                    yield as_batch(schema, *map(list, zip(*rows, strict=True)))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per transaction: record_id, refers_to, uri, and structs request, response, metadata. The records are
    written first, so the archives are parsed once."""
    records = written(records, "warc-records")
    side = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("record_id"), F.struct("record_id", "uri", "page_id").alias(kind))
    answers = records.where("type in ('response', 'revisit')").select(
        "record_id", "refers_to", "uri", F.struct("type", "payload_bytes", "payload_digest", "payload").alias("response")
    )
    return answers.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def page_records(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Archives of the pages written and read back: one row per page."""
    spark = pages.sparkSession
    found = written(captures(read_archives(spark, write_archives(pages, min_revisit))).selectExpr(
        "record_id", "refers_to", "metadata.page_id", "response.type as record_type", "response.payload_bytes", "response.payload_digest"
    ), "warc-captures")
    originals = found.where("record_type = 'response'").selectExpr("record_id as refers_to", "page_id as original")
    return found.join(originals, "refers_to", "left").selectExpr("page_id", "payload_bytes", "payload_digest", "record_type", "original as refers_to")
