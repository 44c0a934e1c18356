"""Approximate nearest neighbours: a vantage-point tree per shard.

Vectors are dealt into shards of bounded size by a hash, once, and queries go to every shard: a task builds a shard's tree
once and streams the queries through it, walking it with a block of them at a time. A subtree is left out for a
query when factor times the triangle inequality's lower bound is above the distance of its k-th nearest so far; factor
1 leaves out only what can't hold a nearer vector, so the search is exact; a larger factor leaves out more. The shards'
k nearest are merged by rank. Distances are Euclidean, in double precision, on the original vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
equal length are compared; of rows with the same id the one with the smallest vector counts, rows with a null id take
no part; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.vectors import sharded

SHARD = 8192  #: vectors of a shard, about
BLOCK = 2048  #: queries of a block, at most
LEAF = 256
NO_ID = np.iinfo(np.int64).max
FACTOR = 1.3


class VpTree:
    """Vantage-point tree over the rows of vectors (double); ids break ties."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.squares, self.looked = (self.vectors**2).sum(1), 0
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The vantage point is the row farthest from the mean: distances from there spread most.
        held = self.vectors[rows]
        at = rows[np.argmax(((held - held.mean(0)) ** 2).sum(1))]
        rest = rows[rows != at]
        d = distances(self.vectors[rest], self.vectors[at])
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        near, far = rest[order[:half]], rest[order[half:]]
        bounds = d[order[0]], d[order[half - 1]], d[order[half]], d[order[-1]]
        return at, bounds, self._build(near), self._build(far)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances (queries x k, inf where there are fewer) and ids of each query's nearest; own: ids left out."""
        best = np.full((len(queries), k), np.inf)
        names = np.full((len(queries), k), NO_ID)

        squares = (queries**2).sum(1)
        slack = 1e-6 * (1 + np.sqrt(squares.max(initial=0)) + np.sqrt(self.squares.max(initial=0)))

        def offer(active: np.ndarray, rows: np.ndarray) -> None:
            """Rows that may be among the nearest by a quick product are measured exactly and merged."""
            self.looked += len(active) * len(rows)
            rough = np.sqrt(np.maximum(squares[active, None] + self.squares[rows] - 2 * queries[active] @ self.vectors[rows].T, 0))
            i, j = np.nonzero((rough <= best[active, -1:] + slack) & (self.ids[rows] != own[active, None]))
            if not len(i):
                return
            d = np.sqrt(((queries[active[i]] - self.vectors[rows[j]]) ** 2).sum(1))
            begun = np.flatnonzero(np.diff(i, prepend=-1))
            count = np.diff(begun, append=len(i))
            who = active[i[begun]]
            place = np.repeat(np.arange(len(begun)), count), np.arange(len(i)) - np.repeat(begun, count)
            more, names_more = np.full((len(begun), count.max()), np.inf), np.full((len(begun), count.max()), NO_ID)
            more[place], names_more[place] = d, self.ids[rows[j]]
            both, ids = np.concatenate([best[who], more], 1), np.concatenate([names[who], names_more], 1)
            order = np.lexsort((ids, both), axis=1)[:, :k]
            best[who], names[who] = np.take_along_axis(both, order, 1), np.take_along_axis(ids, order, 1)

        def visit(node, active: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                if len(node):
                    offer(active, node)
                return
            at, (near0, near1, far0, far1), near, far = node
            d = distances(queries[active], self.vectors[at])
            offer(active, np.array([at]))
            low = {0: np.maximum(np.maximum(near0 - d, d - near1), 0), 1: np.maximum(np.maximum(far0 - d, d - far1), 0)}
            first = (low[0] > low[1]) | ((low[0] == low[1]) & (d > (near1 + far0) / 2))
            for turn in (0, 1):  # each query goes to its nearer child first
                for side, child in ((0, near), (1, far)):
                    # A tie at the bound may still hold a smaller id. Rounding of distances is allowed for.
                    go = (first == (side == 1)) == (turn == 0)
                    go &= factor * low[side] <= best[active, -1] * (1 + 1e-9) + 1e-12
                    if go.any():
                        visit(child, active[go])

        if len(queries) and len(self.ids):
            visit(self.root, np.arange(len(queries)))
        return best, names


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, so equal vectors are at 0 and nothing cancels."""
    return np.sqrt(((rows - point) ** 2).sum(1))


def usable(vector: Column) -> Column:
    """The vector in double precision, or null if it takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors (but the one with the query's id) of each query."""
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v")).dropna().groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, ceil(vectors.agg(F.count(id_col)).first()[0] / shard))

    def by_length(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, ids and vectors of each length."""
        lengths = pc.list_value_length(t.column("v"))
        for n in pc.unique(lengths).to_pylist():
            same = t.filter(pc.equal(lengths, n))
            yield n, same.column("id").to_numpy(), pc.list_flatten(same.column("v")).to_numpy().reshape(-1, n)

    def opened(t: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        trees = {n: VpTree(ids, held) for n, ids, held in by_length(t)}

        def search(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for n, every, held in by_length(pa.Table.from_batches([b])):
                for lo in range(0, len(every) if n in trees else 0, block):
                    own = every[lo : lo + block]
                    d, names = trees[n].search(held[lo : lo + block], own, k, factor)
                    real = np.isfinite(d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k).reshape(-1, k)[real]), pa.array(names[real]), pa.array(d[real])], names=["query_id", "vec_id", "score"])

        return search

    pairs = sharded(clean(vectors), clean(queries), shards, opened, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
