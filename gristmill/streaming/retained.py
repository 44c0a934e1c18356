"""Streams whose state is a bounded map: minutes that are kept for a while, and clients of a limiter that is capped."""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gristmill.operators.limits import take
from gristmill.operators.request_log import EDGES

#: The store that map states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(df: DataFrame) -> None:
    """Checked, not set: the store is a session's choice."""
    if not df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")


class _Minutes(StatefulProcessor):
    """State: minute -> requests, errors, total_ms, counts of the latency bins."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("minutes", "minute long", "requests long, errors long, total_ms double, hist array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: [v[0], v[1], v[2], list(v[3])] for k, v in self.kept.iterator()}
        before, touched = set(known), set()
        for frame in rows:
            for ts, ms, bad in frame.sort_values("seq")[["ts", "ms", "bad"]].itertuples(index=False):
                second = int(ts)
                minute = second - second % 60
                at = known.setdefault(minute, [0, 0, 0.0, [0] * (len(EDGES) + 1)])
                at[0] += 1
                at[1] += bool(bad)
                at[2] += ms
                at[3][bisect_left(EDGES, ms)] += 1
                touched.add(minute)
                # What this row's own time leaves behind goes: a late row takes nothing that a newer one has kept.
                for old in [m for m in known if m <= second - 60 * self.keep]:
                    del known[old]
        for minute in before - set(known):
            self.kept.removeKey((minute,))
        for minute in touched & set(known):
            self.kept.updateValue((minute,), tuple(known[minute]))
        gone = (before | touched) - set(known)
        told = [(key[0], m, *(known[m] if m in known else (0, 0, 0.0, [])), m in known) for m in sorted((touched & set(known)) | gone)]
        yield pd.DataFrame(told, columns=["log", "minute", "requests", "errors", "total_ms", "hist", "kept"])

    def close(self) -> None:
        pass


def retained_minutes(rows: DataFrame, keep_minutes: int) -> DataFrame:
    """Minute buckets of a stream of (log, seq, ts in seconds, ms, bad), each log kept for keep_minutes by its own clock.

    After each batch, a row for each bucket that the batch has touched (kept) or that is gone (not kept, no numbers).
    Rows are taken in order of seq within a batch. A row too late for its minute makes the bucket anew, which stays until
    a newer row lets it go. A log's rows of a batch are one task's; its state is keep_minutes buckets and late ones."""
    _state_store(rows)
    kind = rows.schema["log"].dataType.simpleString()
    cols = rows.select("log", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), F.col("ms").cast("double").alias("ms"), F.col("bad").cast("boolean").alias("bad"))
    return cols.groupBy("log").transformWithStateInPandas(
        statefulProcessor=_Minutes(keep_minutes), outputStructType=f"log {kind}, minute long, requests long, errors long, total_ms double, hist array<long>, kept boolean", outputMode="Append", timeMode="None"
    )


class _Clients(StatefulProcessor):
    """State: client -> tokens, time of the last call, number of the last call in the shard."""

    def __init__(self, capacity: float, refill: float, most: int) -> None:
        self.capacity, self.refill, self.most = capacity, refill, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clients = handle.getMapState("clients", "client string", "tokens double, last double, turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = sorted(((v[2], k[0], v[0], v[1]) for k, v in self.clients.iterator()), key=lambda x: x[0])
        known = OrderedDict((client, (tokens, last, turn)) for turn, client, tokens, last in stored)
        before, turn, used = set(known), (stored[-1][0] if stored else 0), set()
        for frame in rows:
            told = []
            for client, seq, now, cost in frame.sort_values(["ts", "seq"])[["client", "seq", "ts", "cost"]].itertuples(index=False):
                tokens, last, _ = known.pop(client, (self.capacity, None, 0))
                allowed, tokens = take(tokens, last, now, cost, self.capacity, self.refill)
                turn += 1
                known[client] = (tokens, now if last is None else max(last, now), turn)
                used.add(client)
                while len(known) > self.most:
                    known.popitem(last=False)
                told.append((client, seq, allowed, tokens))
            yield pd.DataFrame(told, columns=["client", "seq", "allowed", "tokens"])
        for client in before - set(known):
            self.clients.removeKey((client,))
        for client in used & set(known):
            self.clients.updateValue((client,), known[client])

    def close(self) -> None:
        pass


def capped_limiter(calls: DataFrame, capacity: float, refill: float, max_clients: int = 4096, shards: int = 1) -> DataFrame:
    """client, seq, allowed and tokens of a stream of calls (client, seq, ts in seconds, cost), where at most max_clients are
    remembered: one more lets the client go whose last call is oldest, and that client begins again, full.

    Clients are dealt into shards by hash, each remembers its share; with one shard recency is that of all clients.
    A null client is one like others."""
    if capacity <= 0 or refill <= 0 or max_clients < shards or shards < 1:
        raise ValueError("capacity and refill are above 0, and each shard remembers a client at least")
    _state_store(calls)
    rows = calls.select(F.pmod(F.xxhash64("client"), F.lit(shards)).alias("shard"), F.coalesce(F.col("client").cast("string"), F.lit("")).alias("client"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), F.col("cost").cast("double").alias("cost"))
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Clients(capacity, refill, max_clients // shards), outputStructType="client string, seq long, allowed boolean, tokens double", outputMode="Append", timeMode="None"
    )
