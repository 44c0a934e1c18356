import hashlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, header string"
BIG = "é" * 80


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a", BIG), (1, "http://b\r\nWARC-Type: revisit", BIG), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (7, "u", "x" * 200_000), (7, "u", "x" * 200_000)]
    archive = warc.write_archive(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    got = warc.read_archive(archive).collect()
    assert len(got) == len(rows) and archive.payloads.count() == 4
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to) == ("response", None)
    assert (by[3][0].record_type, by[3][0].refers_to) == ("revisit", 1) and (by[None][0].record_type, by[None][0].refers_to) == ("revisit", 1)
    assert all(r.record_type == "response" for i in (2, 4, 5, 6, 7) for r in by[i])
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = texts[r.record_id]
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == (b"" if r.record_type == "revisit" else body) + b"\r\n\r\n" and head + b"\r\n\r\n" == r.header.encode()
    warc.export_warc(archive, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).filter(F.col("value").startswith("WARC/1.1")).count() == len(rows)


def test_a_changed_payload_is_refused(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string"))
    broken = archive._replace(payloads=archive.payloads.withColumn("payload", F.lit(b"other")))
    with pytest.raises(Exception, match="match its digest"):
        warc.read_archive(broken).collect()


def test_empty_table(spark):
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], SCHEMA))).count() == 0
