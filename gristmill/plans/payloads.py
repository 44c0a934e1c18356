"""Requests rewritten: texts behind the wall change, markers are set, and all other bytes of a payload stay.

Requests are (request_id, payload); further columns are kept. Payloads that are null or no JSON objects stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import json_edit
from gristmill.functions.text import duplicate_note
from gristmill.operators import blocks
from gristmill.operators.near_dup import settled
from gristmill.plans.compaction import compacted, leading

#: Fixed value: the marker that is set where a request has none.
MARKER = '"cache_control": {"type": "ephemeral"}'


def edited(requests: DataFrame, edits: DataFrame) -> DataFrame:
    """requests with their payloads after the edits (request_id, path, kind, text); rows without edits stay. The edits of
    one request, which are parts of its payload, meet in one row."""
    each = edits.groupBy("request_id").agg(F.collect_list(F.struct("path", "kind", "text")).alias("edits"))
    rows = requests.join(each, "request_id", "left").select(*requests.columns, "edits")
    return rows.mapInArrow(json_edit.edit_batches, requests.schema)


def marked(requests: DataFrame) -> DataFrame:
    """requests, where those without a marker get one: on the last tool, or else on the last block of the system, which
    becomes a list if it is a string. Requests with neither stay."""
    rows = settled(blocks.blocks(requests))
    before = rows.groupBy("request_id").agg(F.max("has_marker").alias("had"))
    new = blocks.with_marker(rows).filter("has_marker").join(before.filter("not had"), "request_id")
    place = F.when(F.col("plain"), F.lit("system")).otherwise(F.concat("kind", F.lit("["), "block_idx", F.lit("]")))
    kind = F.when(F.col("plain"), F.lit(json_edit.PROMOTE)).otherwise(F.lit(json_edit.FIELD))
    return edited(requests, new.select("request_id", place.alias("path"), kind.alias("kind"), F.lit(MARKER).alias("text")).distinct())


def shortened_tail(requests: DataFrame, shorten: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """requests after `shorten` of each message block behind the wall, and what was looked at: request_id, path, chars_in,
    chars_out and skipped (no_text, no_win or null). Of a tool result with several texts, the longest is shortened; a
    result that isn't shorter is left out."""
    texts = blocks.largest_sub(blocks.volatile(blocks.blocks(requests)).filter(F.col("block_type").isNull() | F.col("block_type").isin("text", "tool_result")))
    tried = texts.withColumn("new", F.when(F.length("text") > 0, shorten(F.col("text"))))
    skipped = F.when(F.col("text").isNull(), "no_text").when(F.coalesce(F.length("new"), F.length("text")) >= F.length("text"), "no_win")
    tried = settled(tried.withColumn("skipped", skipped).withColumn("path", blocks.json_path()))
    events = tried.select("request_id", "path", F.length("text").alias("chars_in"), F.when(F.col("skipped").isNull(), F.length("new")).otherwise(F.length("text")).alias("chars_out"), "skipped")
    edits = tried.filter("skipped is null").select("request_id", "path", F.lit(json_edit.TEXT).alias("kind"), F.col("new").alias("text"))
    return edited(requests, edits), events


def compact(requests: DataFrame, levels: dict[str, str], least: float = 0.985, min_chars: int = 4000, max_chars: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """requests compacted, and the events (request_id, path, mode, chars_in, chars_out).

    In the order of a request's texts, one of min_chars or more that is nearly the same as a kept earlier text of its
    request gives way to a note; the others go through the chain of `compacted`. Blocks up to the wall stay."""
    rows = blocks.with_wall(blocks.blocks(requests)).filter("not protected and kind <> 'tools' and text is not null")
    order = F.format_string("%010d.%010d.%010d", F.coalesce("msg_idx", F.lit(-1)) + 1, "block_idx", F.coalesce("sub_idx", F.lit(0)))
    rows = settled(rows.select("request_id", blocks.json_path().alias("path"), "text", order.alias("place")))
    led = settled(leading(rows.filter(F.length("text") >= min_chars), "request_id", "place", least=least))
    first = rows.select("request_id", F.col("place").alias("leader"), F.col("path").alias("leader_path"))
    notes = rows.join(led, ["request_id", "place"]).join(first, ["request_id", "leader"])
    notes = notes.select("request_id", "path", F.lit("near-duplicate").alias("mode"), "text", duplicate_note(F.col("text"), F.col("leader_path"), F.col("sim")).alias("new"))
    kept = compacted(rows.join(led, ["request_id", "place"], "left_anti").select("request_id", "path", "text"), levels, max_chars=max_chars, out="new")
    every = settled(notes.unionByName(kept.select("request_id", "path", F.lit("compacted").alias("mode"), "text", "new")).filter("new <> text"))
    events = every.select("request_id", "path", "mode", F.length("text").alias("chars_in"), F.length("new").alias("chars_out"))
    return edited(requests, every.select("request_id", "path", F.lit(json_edit.TEXT).alias("kind"), F.col("new").alias("text"))), events
