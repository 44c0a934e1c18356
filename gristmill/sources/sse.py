"""Server-sent events in chunks of bytes: lines put together across chunks, usage read from their JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.near_dup import settled
from gristmill.operators.sequences import running_sums
from gristmill.operators.usage import AXES, FIELDS, merged


def lines(chunks: DataFrame, by: str = "stream_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """by, at (from 0) and line of the lines of each stream, wherever its chunks were cut, within characters too.

    A chunk has a head, whole lines and a tail. Lines that one chunk has whole are done; heads and tails are put together
    by the number of line feeds before them, a running sum, so that no row and no task holds a stream. A null chunk is an
    empty one; the last line needs no line feed, and an empty one is none."""
    # Bytes as characters of the same numbers, so that text functions can cut and join them.
    bytes_ = F.decode(F.coalesce(chunk, F.lit(b"")), "ISO-8859-1")
    cut = chunks.select(by, F.col(order).alias("__o"), F.split(bytes_, "\n").alias("__cut")).withColumn("__n", F.size("__cut") - 1)
    placed = running_sums(cut, {"__upto": "__n"}, ["__o"], [by])
    first = F.col("__upto") - F.col("__n")
    pieces = placed.select(by, "__o", "__n", first.alias("__first"), F.posexplode("__cut").alias("__i", "__piece")).withColumn("at", F.col("__first") + F.col("__i"))
    inner = (F.col("__i") > 0) & (F.col("__i") < F.col("__n"))
    whole = pieces.filter(inner).select(by, "at", F.col("__piece").alias("line"))
    edges = pieces.filter(~inner).groupBy(by, "at").agg(F.array_sort(F.collect_list(F.struct("__o", "__piece"))).alias("p")).select(by, "at", F.array_join(F.transform("p", lambda x: x["__piece"]), "").alias("line"))
    out = whole.unionByName(edges).withColumn("line", F.regexp_replace("line", "\r$", "")).filter("line <> ''")
    return out.withColumn("line", F.encode("line", "ISO-8859-1").cast("string"))


def events(chunks: DataFrame, by: str = "stream_id", order: str = "seq", chunk: str = "chunk") -> DataFrame:
    """by, at, data: the data lines of each stream, [DONE] and lines that are no JSON left out."""
    # Settled, so that what reads a line many times doesn't put it together as often.
    found = settled(lines(chunks, by, order, chunk).filter(F.col("line").startswith("data:")))
    data = F.trim(F.substring("line", 6, 1 << 30))
    return found.select(by, "at", data.alias("data")).filter((F.col("data") != "[DONE]") & F.try_parse_json("data").isNotNull())


def event_usage(data: Column) -> Column:
    """struct of AXES of one event: its own usage or its message's."""
    known = F.from_json(data, "usage map<string,string>, message struct<usage:map<string,string>>")
    found = lambda f: F.greatest(F.lit(0), F.coalesce(F.element_at(known["usage"], F.lit(f)).try_cast("bigint"), F.lit(0)), F.coalesce(F.element_at(known["message"]["usage"], F.lit(f)).try_cast("bigint"), F.lit(0)))
    return F.struct(*(found(f).cast("long").alias(a) for f, a in zip(FIELDS, AXES, strict=True)))


def usage(chunks: DataFrame, by: str = "stream_id") -> DataFrame:
    """AXES of each stream: the largest number of each that an event tells."""
    parts = events(chunks, by).select(by, event_usage(F.col("data")).alias("u")).select(by, "u.*")
    return merged(parts, by)
