"""Content-addressed WARC archive.

Payload bytes are stored once by their SHA-256 digest, the exact record headers in a second table, and the original
records are rebuilt by a join of the two. A stored payload is accepted on reading only if its digest, computed
anew, is the one it is filed under.

Defined results: a null payload is empty; a null URL has no WARC-Target-URI line; line breaks in a URL are percent-
encoded; rows that repeat an id and a payload are records of the same kind; a row with a null id can't be referred
to, so it is a response unless a row with an id has the same payload; an empty table gives an empty archive. Only the
three named columns are used, so others may have any names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import saved

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    payloads: DataFrame  #: digest string, payload binary, response_id long: a row for each distinct payload
    headers: DataFrame  #: record_id long, digest string, header string: a row for each record


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), record_id.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z"
) -> Archive:
    """Writes a record for each row of pages.

    Of records with equal payloads of at least revisit_min_bytes bytes, that with the smallest id is a response and
    the others revisit it. The payload table takes the one shuffle of payload bytes; partial aggregation keeps one
    payload of a digest per task, so a digest that holds a third of the rows is no hot spot.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    payloads = saved(rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("record_id").alias("response_id")), "warc-payloads")
    known = payloads.select("digest", "response_id", F.octet_length("payload").alias("size"))
    records = rows.select("record_id", "url", "digest").join(known, "digest")
    revisit = (F.col("size") >= revisit_min_bytes) & F.col("response_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("response_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("response_id")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    return Archive(payloads, saved(records.select("record_id", "digest", header.alias("header")), "warc-headers"))


def read_archive(archive: Archive) -> DataFrame:
    """The records, rebuilt: record_id, header, payload binary, record binary (the exact WARC record), record_type,
    payload_bytes, payload_digest, refers_to, all but the first two read from the stored bytes.

    A stored payload whose digest is not the one it is filed under raises an error.
    """
    computed = F.sha2("payload", 256)
    good = archive.payloads.select(
        "digest", F.when(computed == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))).alias("payload")
    )
    field = lambda name: F.regexp_extract("header", rf"(?md)^{name}: (.*)\r$", 1)
    number = lambda name: F.regexp_extract("header", rf"(?md)^{name}: <urn:page:(-?\d+)>\r$", 1)
    whole = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.headers.join(good, "digest").select(
        F.when(number("WARC-Record-ID") != "", number("WARC-Record-ID").cast("long")).alias("record_id"),
        "header",
        "payload",
        F.concat(F.encode("header", "UTF-8"), whole, F.lit(b"\r\n\r\n")).alias("record"),
        field("WARC-Type").alias("record_type"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring(field("WARC-Payload-Digest"), len("sha256:") + 1, 64).alias("payload_digest"),
        F.when(number("WARC-Refers-To") != "", number("WARC-Refers-To").cast("long")).alias("refers_to"),
    )


def export_warc(archive: Archive, path: str) -> None:
    """Writes the records as gzipped .warc text files, a part for each task. Payloads are taken as UTF-8."""
    record = F.concat("header", F.when(F.col("record_type") == "revisit", "").otherwise(F.decode("payload", "UTF-8")))
    read_archive(archive).select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
