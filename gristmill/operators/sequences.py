"""Long ordered sequences without a task that holds one: running sums, the row before of the same key, reuse distances.

Rows are dealt by range, so that a sequence lies in neighbouring parts, however long it is; each part is summed up in
one row, the sums are carried over the parts, and each part goes on from what came before it. Order columns decide ties;
rows that are equal in all of them come in any order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.near_dup import settled

PART = "__seq_part"
#: Chunks into which reuse_distances cuts a sequence: the table of chunk by chunk (at most their square) fits a task.
CHUNKS = 1024


def in_parts(rows: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """rows with the number of their part: parts follow each other in the order, and each is a task's. Without a number
    of parts, Spark sizes them."""
    return settled(rows.repartitionByRange(*([parts] if parts else []), *order).withColumn(PART, F.spark_partition_id()))


def running_sums(rows: DataFrame, sums: dict[str, str], order: list[str | Column], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with a column for each entry of sums (new column: column to add up; null adds nothing), up to and with the row
    itself, in order, within equal values of by (null is a value)."""
    by = by or []
    dealt = in_parts(rows, *by, *order, parts=parts)
    within = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row for each part and value of by.
    totals = dealt.groupBy(PART, *by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(PART).alias("__seq_p"), *(F.col(c).alias(f"__seq_by_{c}") for c in by), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__seq_{n}") for n in sums))
    same = F.col(PART) == F.col("__seq_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__seq_by_{c}"))
    own = dealt.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()))
    return own.join(before, same).select(*rows.columns, *((F.col(n) + F.col(f"__seq_{n}")).alias(n) for n in sums))


def row_before(rows: DataFrame, value: str, order: list[str], by: list[str], name: str, parts: int | None = None) -> DataFrame:
    """rows with the value of the row before, in order, within equal values of by; null for the first."""
    dealt = in_parts(rows, *by, *order, parts=parts)
    within = Window.partitionBy(PART, *by).orderBy(*order)
    last = dealt.groupBy(PART, *by).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy(PART)
    carried = last.select(F.col(PART).alias("__seq_p"), *(F.col(c).alias(f"__seq_by_{c}") for c in by), F.lag("__last").over(earlier)["__v"].alias("__carried"))
    same = F.col(PART) == F.col("__seq_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__seq_by_{c}"))
    own = dealt.withColumn("__before", F.lag(value).over(within))
    return own.join(carried, same).select(*rows.columns, F.coalesce("__before", "__carried").alias(name))


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each value, how many before it are smaller: halves are merged bottom up, all pairs of halves at once."""
    n = len(values)
    out = np.zeros(n, np.int64)
    order = np.lexsort((-np.arange(n), values))  # equal values: the later first, so that it doesn't count the earlier
    width = 1
    while width < n:
        pair = order // (2 * width)
        merged = order[np.argsort(pair, kind="stable")]
        left = merged // width % 2 == 0
        count = np.cumsum(left)
        group = merged // (2 * width)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.repeat(count[starts] - left[starts], np.diff(np.append(starts, n)))
        right = ~left
        out[merged[right]] += (count - base)[right]
        width *= 2
    return out


def _grouped(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """cache, pos and name: smaller_before of value in order, within keys; a group is one chunk."""

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by(order)
        return pa.table({"cache": found.column("cache"), "pos": found.column("pos"), name: smaller_before(found.column(value).to_numpy())})

    return rows.select(*dict.fromkeys([*keys, "cache", "pos", order, value])).groupBy(*keys).applyInArrow(run, f"cache {rows.schema['cache'].dataType.simpleString()}, pos long, {name} long")


def reuse_distances(accesses: DataFrame, order: list[str], key: str = "key", by: str = "cache", chunks: int = CHUNKS, parts: int | None = None) -> DataFrame:
    """accesses with distance: how many other keys were used since the key was last used, in order within by; null for a
    first use.

    With numbered accesses, it is the number of accesses before this one whose key was last used before this key's last
    use, less that use's number. They are counted in three parts: in earlier chunks and by last uses in earlier chunks,
    from a table of counts by both; by last uses in the same chunk, in its group; and within the access's own chunk."""
    rows = accesses.withColumn("__one", F.lit(1))
    rows = running_sums(rows, {"__pos": "__one"}, order, [by], parts)
    rows = settled(row_before(rows, "__pos", ["__pos"], [by, key], "__prev", parts))
    size = rows.groupBy(F.col(by).alias("__c")).agg(F.greatest(F.lit(1), F.ceil(F.max("__pos") / chunks)).cast("long").alias("__size"))
    numbered = rows.join(size, F.col(by).eqNullSafe(F.col("__c")))
    chunk = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.floor((F.col(c) - 1) / F.col("__size"))).cast("long")
    places = settled(numbered.select(F.col(by).alias("cache"), F.col("__pos").alias("pos"), F.coalesce("__prev", F.lit(0)).alias("prev"), chunk("__pos").alias("chunk"), chunk("__prev").alias("block")))

    def earlier(found: pa.Table) -> pa.Table:
        c, b, n = (found.column(x).to_numpy() for x in ("chunk", "block", "n"))
        table = np.zeros((int(c.max()) + 2, int(c.max()) + 3), np.int64)
        table[c + 1, b + 2] = n
        before = table.cumsum(0).cumsum(1)
        return pa.table({"cache": found.column("cache"), "chunk": found.column("chunk"), "block": found.column("block"), "far": before[c, b + 1]})

    kind = places.schema["cache"].dataType.simpleString()
    cells = places.groupBy("cache", "chunk", "block").agg(F.count("*").alias("n"))
    far = cells.groupBy("cache").applyInArrow(earlier, f"cache {kind}, chunk long, block long, far long").select(F.col("cache").alias("c1"), F.col("chunk").alias("k1"), F.col("block").alias("b1"), "far")
    again = places.filter("block >= 0")
    near = _grouped(again, ["cache", "block"], "prev", "chunk", "near").select(F.col("cache").alias("c2"), F.col("pos").alias("p2"), "near")
    own = _grouped(places, ["cache", "chunk"], "pos", "prev", "own").select(F.col("cache").alias("c3"), F.col("pos").alias("p3"), "own")
    told = again.join(far, F.col("cache").eqNullSafe(F.col("c1")) & (F.col("chunk") == F.col("k1")) & (F.col("block") == F.col("b1")))
    told = told.join(near, F.col("cache").eqNullSafe(F.col("c2")) & (F.col("pos") == F.col("p2"))).join(own, F.col("cache").eqNullSafe(F.col("c3")) & (F.col("pos") == F.col("p3")))
    told = told.select(F.col("cache").alias("__cache"), F.col("pos").alias("__at"), (F.col("far") + F.col("near") + F.col("own") - F.col("prev")).alias("distance"))
    return rows.join(told, F.col(by).eqNullSafe(F.col("__cache")) & (F.col("__pos") == F.col("__at")), "left").select(*accesses.columns, "distance")

