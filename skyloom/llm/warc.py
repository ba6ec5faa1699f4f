"""WARC archives: written and read by Spark, repeated payloads resolved into revisit records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import folder

CRLF = "\r\n"
END = CRLF * 2
VERSION = "WARC/1.0" + CRLF
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FETCHED = "2024-01-01T00:00:00Z"
HEX_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "file string, record_id string, record_type string, page_id long, url string, digest string, payload_bytes long, refers_to_record string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of bytes: every five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), HEX_DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, nothing where the value is missing; line ends inside a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_archives(records: DataFrame, path: str) -> None:
    """One gzip file a partition of ``records``, a WARC record a row.

    Columns as ``read_archives`` gives them, ``payload`` binary (a revisit's is left out, its HTTP header keeps the full length).
    A record is one row of Spark's text writer, whose line end is the two line ends that close a record.
    """
    visit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF), _line("Content-Length", F.col("payload_bytes")), F.lit(CRLF))
    block = F.concat(http, F.when(visit, F.lit("")).otherwise(F.col("payload").cast("string")))
    head = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.lit(FETCHED)),
        _line("WARC-Target-URI", F.col("url")),
        _line("X-Page-ID", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_record", F.lit(">"))),
        _line("WARC-Profile", F.when(visit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit(CRLF),
    )
    rows = records.withColumn("block", block).select(F.concat(head, "block").alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split(CRLF)[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _record(path: str, head: bytes, block: bytes) -> tuple:
    f = _fields(VERSION.encode() + head)
    http, sep, payload = block.partition(END.encode())
    if not sep or not f.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    kind = f.get("warc-type", "")
    full = _fields(http).get("content-length", "") if kind == "revisit" else ""
    page = f.get("x-page-id", "")
    return (
        path, f.get("warc-record-id", "").strip("<>"), kind, int(page) if page.lstrip("-").isdigit() else None, f.get("warc-target-uri"),
        f.get("warc-payload-digest", "").removeprefix("sha1:"), int(full) if full.isdigit() else len(payload), f.get("warc-refers-to", "").strip("<>") or None, payload,
    )


def _parser(with_payload: bool):
    columns = [x.split()[0] for x in RECORD.split(", ")] + ["payload"]
    mark = (END + VERSION).encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, head, block, need = None, b"", b"", -1  # an unfinished record: its payload held the mark between records
        for batch in batches:
            out = []
            for path, piece in zip(batch["path"], batch["value"], strict=True):
                if path != here:
                    here, need = path, -1
                    piece = piece.removeprefix(VERSION.encode())
                if need < 0:
                    head, _, block = piece.partition(END.encode())
                    need = int(_fields(VERSION.encode() + head).get("content-length", 0))
                else:
                    block += mark + piece
                if len(block) >= need:
                    out.append(_record(path, head, block[:need]))
                    need = -1
            found = pd.DataFrame(out, columns=columns)
            found["page_id"] = found["page_id"].astype("Int64")
            yield found if with_payload else found.drop(columns="payload")

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of gzip archives, one row each; a gzip file is read by one task, record by record.

    Pieces between record marks are joined again until the stated length is reached, so a payload may hold anything.  A
    truncated last record is left out.
    """
    pieces = spark.read.option("lineSep", END + VERSION).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInPandas(_parser(with_payload), RECORD + (", payload binary" if with_payload else ""))


def revisits_of(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(record_id, refers_to_record)`` of records whose payload an earlier record holds.

    Only headers are shuffled.  Payloads of ``min_bytes`` or more are equal where digest and length are; the smallest page_id
    (nulls last, ties by record id) is the original.  The originals are a partial aggregate, and only digests seen twice meet the headers
    again, in a join that adaptive execution splits where one digest holds many records.
    """
    long_enough = headers.where(F.col("payload_bytes") >= min_bytes)
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id"))
    originals = long_enough.groupBy("digest", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    originals = originals.select("digest", "payload_bytes", F.col("first.record_id").alias("refers_to_record"))
    return long_enough.select("record_id", "digest", "payload_bytes").join(originals, ["digest", "payload_bytes"]).where("record_id != refers_to_record").select("record_id", "refers_to_record")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Write the archives of ``source`` to ``target`` with repeated payloads as revisit records under fresh headers."""
    decided = revisits_of(read_archives(spark, source, with_payload=False), min_bytes)
    records = read_archives(spark, source).drop("refers_to_record", "file").join(decided, "record_id", "left")
    kind = F.when(F.col("refers_to_record").isNotNull(), "revisit").otherwise(F.col("record_type"))
    write_archives(records.withColumn("record_type", kind), target)


def archive_pages(pages: DataFrame, min_bytes: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> tuple[str, DataFrame]:
    """Pages as deduplicated archives: their folder, and one row a record as read back from it.

    A null html is an empty payload; null urls and ids are kept as missing headers.  Repeated rows are records of their own, of which
    one is the response.  An empty table gives no rows; other columns are not read.  ``refers_to`` is the page id of a
    revisit's response.
    """
    spark = pages.sparkSession
    raw, final = folder(spark, "warc-raw"), folder(spark, "warc")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select(
        "*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit("response").alias("record_type"), F.concat(F.lit("urn:uuid:"), F.expr("uuid()")).alias("record_id"), F.lit(None).cast("string").alias("refers_to_record"),
    )
    write_archives(rows, raw)
    deduplicate(spark, raw, final, min_bytes)
    found = read_archives(spark, final, with_payload=False)
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    return final, found.join(responses, "refers_to_record", "left")
