"""How quality filters act on each other, for every order in which they can be applied.

A document's failures are a mask of bits, one a filter; documents are counted by part and mask. Orders are visited by
swapping two neighbours at a time, so that each order differs from the one before in two steps only, and only these are
counted anew, from the cells of the masks. A filter's Shapley sum is carried along the same walk.

Filters: A under 200 words, B less than half of the words different, C more than 2 % capitals A-Z, D holds one of
#$%&*|, E text equal to that of a smaller doc_id.

Defined results: a null text is an empty text (it fails A; B and C compare 0 with 0 and pass). A null source is the part
'', as is an empty one. A null doc_id is larger than all others; rows that share doc_id and text do not make each other
fail E. A document that has several labels is good, or toxic, if one of them says so; without labels, or without a doc_id, it is neither.
Columns of other names are passed over. No rows give no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def swaps(n: int) -> Iterator[int]:
    """Places of the neighbours to swap (i with i + 1), one after the other, so that all n! orders of n things come up
    once: the last thing moves through the orders of the others and turns round at each end."""
    if n < 2:
        return
    away, others = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if away else range(n - 1)
        inner = next(others, None)
        if inner is None:
            return
        yield inner + 1 if away else inner
        away = not away


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, print (of the text) and mask: bits 1, 2, 4 and 8 for failing A, B, C and D."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("print"),
        F.length(text).cast("long").alias("chars"), (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("capitals"),
        text.rlike(r"[#$%&*|]").alias("marks"), F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("different")))[0].alias("words"),
    )
    fails = [F.col("words.n") < 200, 100 * F.col("words.different") < 50 * F.col("words.n"), 100 * F.col("capitals") > 2 * F.col("chars"), F.col("marks")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", "print", mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (E is bit 16), and of the documents of each: docs, good, toxic.

    Copies are counted by text, part and labels before they meet, so that a text that a third of all rows hold is a few
    rows a task."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = failures(docs).join(marked, "doc_id", "left").select("doc_id", "part", "print", "mask", zero("quality"), zero("toxic"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    kind = ["print", "part", "mask", "quality", "toxic"]
    same = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n")).withColumn("order", order)
    groups = same.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("order", "n")).alias("least"))
    # Rows of one text and doc_id have one set of labels, but may lie in several parts.
    least = groups.groupBy("print").agg(F.min("least.order").alias("order"))
    firsts = F.when(F.col("least.order") == F.col("order"), F.col("least.n")).otherwise(0)
    split = groups.join(least, "print").select("part", "mask", "quality", "toxic", firsts.alias("firsts"), (F.col("n") - firsts).alias("again"))
    each = split.select("part", "quality", "toxic", F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("again").alias("n")))).alias("c"))
    return each.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("docs"), F.sum(F.col("c.n") * F.col("quality")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def walk(table: np.ndarray, filters: str = FILTERS) -> Iterator[tuple[str, np.ndarray]]:
    """table (parts, masks, 3): documents, good and toxic ones by mask. Yields each order with an array (parts, steps, 6)
    of kept, removed, redundant, unique_fails, good_lost and toxic_lost, which is only good until the next order."""
    n = len(filters)
    masks = np.arange(1 << n)
    fails = [(masks >> f) & 1 == 1 for f in range(n)]
    everything, order = table[:, :, 0].sum(1), list(range(n))
    out = np.zeros((len(table), n, 6), np.int64)
    failing = [table[:, f, 0].sum(1) for f in fails]
    alone = [table[:, 1 << f, 0] for f in range(n)]

    def count(step: int) -> None:
        before = sum(1 << f for f in order[:step])
        here = fails[order[step]] & (masks & before == 0)
        lost = table[:, here].sum(1)
        kept = (out[:, step - 1, 0] if step else everything) - lost[:, 0]
        out[:, step] = np.stack([kept, lost[:, 0], failing[order[step]] - lost[:, 0], alone[order[step]], lost[:, 1], lost[:, 2]], axis=1)

    for step in range(n):
        count(step)
    yield "".join(filters[f] for f in order), out
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i)
        count(i + 1)
        yield "".join(filters[f] for f in order), out


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all orders for some parts at a time."""
    n = len(FILTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("part")
        table = np.zeros((batch.num_rows, 1 << n, 3), np.int64)
        for p, found in enumerate(batch.column("cells").to_pylist()):
            for c in found:
                table[p, c["mask"]] = c["docs"], c["good"], c["toxic"]
        shapley = np.zeros((batch.num_rows, n), np.int64)
        for order, counts in walk(table):
            for step, f in enumerate(order):
                shapley[:, FILTERS.index(f)] += counts[:, step, 1]
        for order, counts in walk(table):
            for step, f in enumerate(order):
                columns = [parts, pa.array([order] * len(parts)), pa.array([step + 1] * len(parts), pa.int32())]
                columns += [pa.array(counts[:, step, k]) for k in range(6)] + [pa.array(shapley[:, FILTERS.index(f)])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *_COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    by_part = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))  # 32 cells at most
    return by_part.mapInArrow(_walked, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
