"""WARC archives whose repeated payloads are revisit records.

Headers (id, payload digest, length) are shuffled by digest, never the payloads; the record with the largest id of a
digest stays a response, later writes of the same payload become revisits that name it. Archives are written by Spark's
text writer, one record per line with the record end as line separator, so a part file is a gzip-compressed WARC file
(Spark names it .txt.gz). The reader takes the files back, follows each record's Content-Length and joins revisits to
their responses.

Defined results: a null payload is empty; payloads below `least` bytes are always responses. Records without id are
responses and no revisit refers to them. Rows repeated with id and payload are equal records. Control characters in a
target URI are written as spaces, a null URI is left out. An empty table gives archives without records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import BATCH_ROWS, checked_broadcast, durable, query, scratch_path

LEAST_BYTES = 1000
RECORD_END = "\r\n\r\n"
#: Records of one archive file; a reader holds one compressed file at a time.
FILE_RECORDS = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def with_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and `original`, the id of the response that a revisit refers to, else null."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    headers = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
    first = headers.agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    first = durable(first.filter("n > 1 and largest is not null").drop("n"))
    rows = rows.join(checked_broadcast(first, first.count()), "payload_digest", "left")
    return rows.withColumn("original", F.when(F.col("page_id") != F.col("largest"), F.col("largest"))).drop("largest")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    rows = with_types(pages, least)
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        maybe("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1F\x7F]", " ")),
        maybe("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("original"), F.col("payload_digest"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(F.concat(head, "block").alias("record"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(": ") for x in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of a gzip-compressed archive, decompressed as it is read."""
    unzip, held, at = zlib.decompressobj(31), b"", 0
    while True:
        stop = held.find(b"\r\n\r\n")
        need = 0
        if stop >= 0:
            head = _fields(held[:stop])
            need = stop + 4 + int(head["content-length"])
            if len(held) >= need + len(RECORD_END):
                yield head, held[stop + 4:need]
                held = held[need + len(RECORD_END):]
                continue
        parts, size = [held], len(held)
        while at < len(content) and (len(parts) == 1 or size < need + len(RECORD_END)):
            parts.append(unzip.decompress(content[at:at + (1 << 18)]))
            size += len(parts[-1])
            at += 1 << 18
        if len(parts) == 1:
            if held:
                raise ValueError("archive ends inside a record")
            return
        held = b"".join(parts)


_READ = ["page_id", "record_id", "record_type", "refers_id", "payload_bytes", "payload_digest", "payload"]
_READ_SCHEMA = "page_id long, record_id string, record_type string, refers_id string, payload_bytes long, payload_digest string, payload string"


def _parse(payloads: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length, digest = int(_fields(http)["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response":
            length, found = len(payload), hashlib.sha1(payload).hexdigest()
            if found != digest:
                raise ValueError(f"{head['warc-record-id']}: the payload has digest {found}, its header {digest}")
        text = payload.decode() if payloads and head["warc-type"] == "response" else None
        return int(head["x-page-id"]) if "x-page-id" in head else None, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), length, digest, text

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                rows, size = [], 0
                for head, block in records_of(bytes(content)):
                    rows.append(row(head, block))
                    size += len(block)
                    if size > 1 << 23:
                        yield pd.DataFrame(rows, columns=_READ).astype({"page_id": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_READ).astype({"page_id": "Int64"})
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A written table of the records: ids, type, reference, length and digest of the full payload and, if asked, the payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # one file at a time
    found = files.mapInPandas(_parse(payloads), _READ_SCHEMA)
    found = durable(found if payloads else found.drop("payload"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return found


def resolved(records: DataFrame) -> DataFrame:
    """Adds `refers_to`, the page_id of a revisit's response; with payloads, revisits get that response's payload."""
    named = records.filter("record_type = 'response' and page_id is not null")
    wanted = records.filter("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct()
    named = named.join(wanted, "record_id", "left_semi").groupBy("record_id").agg(
        F.max("page_id").alias("refers_to"), *([F.max("payload").alias("original_payload")] if "payload" in records.columns else []))
    named = durable(named).withColumnRenamed("record_id", "refers_id")
    out = records.join(checked_broadcast(named, named.count()), "refers_id", "left")
    if "payload" in records.columns:
        out = out.withColumn("payload", F.coalesce("payload", "original_payload")).drop("original_payload")
    return out


@query("op5_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
""")
def _op5(table):
    pages = table("pages")
    path = scratch_path(pages.sparkSession, "archive")
    write_archives(pages, path)
    return resolved(read_archives(pages.sparkSession, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
