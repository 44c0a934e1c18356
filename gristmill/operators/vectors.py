"""Exact cosine search over vectors, a table of vectors with markers for what is deleted, and embedding by a client."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Queries up to this number are sent to the vectors (they are counted); more are dealt to shards of vectors.
FEW = 1000
SHARD = 65_536  #: vectors of a shard, about
CELLS = 1 << 22  #: similarities held at a time


def sharded(rows: DataFrame, asked: DataFrame, shards: int, opened: Callable[[pa.Table], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """What a search gives for all queries (asked: id, v) in every shard of the vectors (rows: the same columns).

    Vectors are dealt by their id's hash, once; queries go to each shard. A task has a shard's vectors first, calls opened
    with them once, and streams the queries through what that gives: it holds a shard, and never all queries.
    """
    held = rows.select("id", "v", F.lit(False).alias("asked"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    sent = asked.select("id", "v", F.lit(True).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = held.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "asked")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, search = None, [], None
        for b in batches:
            shard, kind = b.column("shard").to_numpy(), b.column("asked").to_numpy(zero_copy_only=False).astype(np.int8)
            begun = np.flatnonzero(np.diff(2 * shard.astype(np.int64) + kind, prepend=-1)) if len(shard) else []
            for lo, hi in zip(begun, [*begun[1:], len(shard)], strict=True):
                if shard[lo] != at:
                    at, parts, search = shard[lo], [], None
                part = b.slice(lo, hi - lo)
                if kind[lo]:
                    search = search or opened(pa.Table.from_batches(parts, b.schema))
                    parts = []
                    yield from search(part)
                else:
                    parts.append(part)

    return dealt.mapInArrow(run, schema)


def _by_length(vectors: list[list[float] | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows, scaled to length 1 (a zero row stays zero), of the vectors of each length; null has length 0."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        places.setdefault(len(v or []), []).append(i)
    out = {}
    for n, at in places.items():
        m = np.array([vectors[i] or [] for i in at], np.float64).reshape(len(at), n)
        norms = np.sqrt((m * m).sum(1, keepdims=True))
        out[n] = np.array(at), np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    return out


def _best(names: np.ndarray, asked: dict, ids: np.ndarray, held: dict, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id and sim of what may be among the k best of each query; rounding comes later, so near ties stay."""
    step = max(1, CELLS // max(1, len(ids)))
    for n, (places, units) in asked.items():
        for lo in range(0, len(places), step):
            sims = np.zeros((len(places[lo : lo + step]), len(ids)))
            if n and n in held:
                fit, rows = held[n]
                sims[:, fit] = units[lo : lo + step] @ rows.T
            least = np.partition(sims, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(sims), -np.inf)
            q, i = np.nonzero(sims >= least[:, None] - 2e-6)
            yield pa.RecordBatch.from_arrays([pa.array(names[places[lo : lo + step]][q], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(sims[q, i])], names=["query_id", "id", "sim"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", few: int = FEW, shard: int = SHARD) -> DataFrame:
    """query_id, id, sim, rank: the k vectors with the largest cosine for each query, ties to the smaller id.

    Up to `few` queries go to the tasks, and no vector is shuffled; for more, see sharded(). Both score by matrix products
    and keep the k best of a batch or shard for each query. Vectors that are null or of another length than a query's have
    cosine 0 with it, as have zero vectors; queries without an id have no result, nor are vectors without one found.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null")
    rows, asked = clean(vectors), clean(queries)
    schema, best = "query_id long, id long, sim double", Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    numbers = lambda x: x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()

    sent = asked.limit(few + 1).collect()
    if len(sent) <= few:
        names, sides = np.array([r["id"] for r in sent], np.int64), _by_length([r["v"] for r in sent])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _best(names, sides, numbers(b.column("id")), _by_length(b.column("v").to_pylist()), k)

        scored = rows.mapInArrow(run, schema)
    else:

        def opened(t: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
            ids, held = numbers(t.column("id")), _by_length(t.column("v").to_pylist())
            return lambda b: _best(numbers(b.column("id")), _by_length(b.column("v").to_pylist()), ids, held, k) if len(ids) else iter(())

        scored = sharded(rows, asked, max(1, -(-rows.count() // shard)), opened, schema)
    return scored.withColumn("sim", F.round("sim", 6)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def semantic_hits(vectors: DataFrame, queries: DataFrame, threshold: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, sim of the best vector of each query where its similarity is at least threshold."""
    return top_k(vectors, queries, 1, id_col, vector_col).filter(F.col("sim") >= threshold).drop("rank")


def embedded(rows: DataFrame, opened: Callable[[], Callable[[list[str]], list[list[float]]]], text_col: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """rows with the vectors that a client gives their texts, `batch` at a time; null for a null text.

    opened is called once in each task, before its first text, and gives the client: a function from texts to as many
    vectors, all of one length. Anything else is an error, as is a number that isn't finite."""
    schema = rows.withColumn(out, F.lit(None).cast("array<double>")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, length = None, None
        for b in batches:
            texts = b.column(text_col).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            found: list = [None] * len(texts)
            for lo in range(0, len(asked), batch):
                client = client or opened()
                some = asked[lo : lo + batch]
                got = np.asarray(client([texts[i] for i in some]), np.float64)
                if got.ndim != 2 or len(got) != len(some) or got.shape[1] != (length or got.shape[1]) or not np.isfinite(got).all():
                    raise ValueError(f"{len(some)} texts gave vectors of shape {got.shape}")
                length = got.shape[1]
                for i, v in zip(some, got.tolist(), strict=True):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c != out] + [pa.array(found, pa.list_(pa.float64()))], names=[c for c in b.schema.names if c != out] + [out])

    kept = [f for f in schema.fields if f.name != out]
    return rows.select(*(f.name for f in kept)).mapInArrow(run, T.StructType([*kept, schema[out]]))


#: Rows of a table of vectors: seq orders the changes of an id, deleted marks one that is gone.
VECTOR = "vec_id long, embedding array<double>, seq long, deleted boolean"


def upserted(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (VECTOR) after changes (the same columns; deleted rows need no embedding): the newest row of each id. Markers
    stay, so that an older change that comes later brings nothing back. Of equal seq, a deletion wins, then the larger
    vector."""
    every = table.unionByName(changes.select(*table.columns)).filter("vec_id is not null")
    newest = F.max(F.struct("seq", "deleted", "embedding"))
    return every.groupBy("vec_id").agg(newest.alias("n")).select("vec_id", F.when(~F.col("n.deleted"), F.col("n.embedding")).alias("embedding"), "n.seq", "n.deleted")


def live(table: DataFrame) -> DataFrame:
    """vec_id and embedding of what isn't deleted, for top_k and semantic_hits."""
    return table.filter(~F.coalesce("deleted", F.lit(False))).select("vec_id", "embedding")
