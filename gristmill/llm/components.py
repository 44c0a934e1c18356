"""Connected components: few links in one task, more by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Links up to this number (they are counted) are joined by union-find in one task; more, by steps over all tasks, until
#: few are left.
ONE_TASK = 400_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above[x]) != x:
                above[x] = above[y]
                x = above[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = root(above.setdefault(u, u)), root(above.setdefault(v, v))
                above[max(x, y)] = min(x, y)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([root(x) for x in above], kind)], names=["node", "root"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """node, root (the component's smallest node) for each node of links. Both columns have one orderable type.

    Every step is joins and minima over edges; a node with very many edges is pre-aggregated, and each step's edges are
    written to the shared folder, so nothing but two numbers reaches the driver.
    """
    edges = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    before = _state(edges)
    while before[0] > one_task:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u != m").select("u", F.col("m").alias("v"))).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(roots.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "edges")
        after = _state(edges)
        if after == before:
            return _ends(edges)
        before = after
    return _in_one_task(edges)


def _ends(edges: DataFrame) -> DataFrame:
    """node, root of stars."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
