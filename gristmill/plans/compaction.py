"""The text pipeline: near-duplicates out, long texts shortened, then the rewriting engines in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.rewrite import rewrite_text
from gristmill.functions.sketch import projection_blake2b, signed_projection
from gristmill.functions.text import middle_out, shingles, words
from gristmill.operators.near_dup import leaders

#: Fixed value: the order of the engines after shortening.
ORDER = ("json_aware", "caveman", "rtk")


def _engines(texts: DataFrame, levels: list[tuple[str, str]], out: str) -> DataFrame:
    """texts (key, text) as key and out: the text after each of the engines at its level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("text").to_pylist()
            for name, level in levels:
                said = [rewrite_text(name, t, level)[0] for t in said]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(said, pa.string())], names=["key", out])

    return texts.select("key", "text").mapInArrow(run, f"key binary, `{out}` string")


def compacted(rows: DataFrame, levels: dict[str, str], text_col: str = "text", max_chars: int = 12_000, out: str = "compacted") -> DataFrame:
    """rows with out: the text after shortening and each engine that levels names (json_aware, caveman, rtk, in this order).

    Each different text is rewritten once, and is met again by its digest. A null text stays null, an empty one empty.
    """
    on = [(name, levels[name]) for name in ORDER if levels.get(name, "off") != "off"]
    for name, level in on:
        rewrite_text(name, None, level)
    key = F.unhex(F.sha2(F.col(text_col), 256))
    texts = rows.filter(F.col(text_col).isNotNull()).groupBy(key.alias("key")).agg(F.first(middle_out(F.col(text_col), max_chars)).alias("text"))
    new = _engines(texts, on, out)
    return rows.withColumn("__text_key", key).join(new.withColumnRenamed("key", "__text_key"), "__text_key", "left").drop("__text_key")


def deduplicated(rows: DataFrame, group_col: str, id_col: str, text_col: str = "text", least: float = 0.985, seed: str = "compaction", width: int = 64) -> DataFrame:
    """rows with leader: within its group (a request), the most similar earlier text kept whose projection has a cosine of
    at least `least` with this one's; null for texts that are kept. Groups are the texts of one request, so all pairs
    within are compared. Null and empty texts are kept, and lead none."""
    sketched = rows.filter(F.length(text_col) > 0).select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), projection_blake2b(shingles(words(F.col(text_col)), 5), seed, width).alias("v"))
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    pairs = sketched.join(sketched.select("grp", F.col("id").alias("b"), F.col("v").alias("w")), "grp").filter(F.col("id") < F.col("b")).select("grp", F.col("id").alias("a"), "b", dot.alias("sim")).filter(F.col("sim") >= least)
    led = leaders(sketched.select("grp", "id"), pairs.select("a", "b", "sim")).filter("leader is not null").select(F.col("id").alias(id_col), "leader")
    return rows.join(led, id_col, "left")


def leading(rows: DataFrame, group_col: str, place_col: str, text_col: str = "text", least: float = 0.985, seed: str = "compaction", width: int = 64) -> DataFrame:
    """group, place, leader and sim of the texts that give way to an earlier one: in order of place (an orderable string),
    a text is kept unless the most similar kept one before it in its group has a cosine of at least `least` (the first on
    ties). A group is the long texts of one request, which its payload bounds, and is folded in one task."""
    kinds = dict(rows.dtypes)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = pa.array([signed_projection(p or [], seed, width) for p in x.column("parts").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x.column(group_col), x.column(place_col), v], names=[group_col, place_col, "v"])

    parts = rows.select(group_col, place_col, shingles(words(F.col(text_col)), 5).alias("parts"))
    sketched = parts.mapInArrow(sketch, f"{group_col} {kinds[group_col]}, {place_col} string, v array<double>")

    def fold(found: pa.Table) -> pa.Table:
        found = found.sort_by(place_col)
        vectors = np.array(found.column("v").to_pylist()).reshape(found.num_rows, -1)
        kept: list[int] = []
        out = []
        for i, v in enumerate(vectors):
            sims = vectors[kept] @ v
            best = int(sims.argmax()) if kept else -1
            if kept and sims[best] >= least:
                out.append((i, kept[best], float(sims[best])))
            else:
                kept.append(i)
        i, j, sim = (pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), (pa.int64(), pa.int64(), pa.float64())))
        place = found.column(place_col)
        return pa.table({group_col: found.column(group_col).take(i), place_col: place.take(i), "leader": place.take(j), "sim": sim})

    return sketched.groupBy(group_col).applyInArrow(fold, f"{group_col} {kinds[group_col]}, {place_col} string, leader string, sim double")


def responses(rows: DataFrame, text_col: str = "text", max_chars: int = 20_000) -> DataFrame:
    """Responses are only shortened."""
    return rows.withColumn("compacted", middle_out(F.col(text_col), max_chars))


def savings(before: str, after: str, mode: str) -> list:
    """Columns of a compaction event: mode, original_chars, compressed_chars, saved, sha256."""
    return [
        F.lit(mode).alias("mode"), F.length(before).alias("original_chars"), F.length(after).alias("compressed_chars"),
        F.greatest(F.lit(0), F.length(before) - F.length(after)).alias("saved"), F.substring(F.sha2(before, 256), 1, 16).alias("sha256"),
    ]
