"""Token buckets: per client a capacity that refills with time, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def take(tokens: float, last: float | None, now: float, cost: float, capacity: float, refill: float) -> tuple[bool, float]:
    """Whether cost may be taken at now, and the tokens left. Time running backwards refills nothing."""
    tokens = min(capacity, tokens + max(0.0, now - (now if last is None else last)) * refill)
    if cost <= 0:
        return True, tokens
    return (True, tokens - cost) if tokens >= cost else (False, tokens)


def limited(calls: DataFrame, capacity: float, refill: float, client: str = "client", ts: str = "ts", cost: str = "cost", tie: str = "seq") -> DataFrame:
    """client, seq, allowed, tokens for each call (ts in seconds), in order of ts and seq within a client.

    A client's calls are a sequence; its task streams them in order and remembers two numbers.
    """
    rows = calls.selectExpr(f"{client} as client", f"cast({ts} as double) as ts", f"cast({cost} as double) as cost", f"cast({tie} as long) as seq")
    rows = rows.repartition("client").sortWithinPartitions("client", "ts", "seq")

    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, begun, tokens, last = None, False, capacity, None
        for frame in batches:
            allowed, left = [], []
            for c, now, price in zip(frame["client"], frame["ts"], frame["cost"]):
                if not begun or c != who:
                    who, begun, tokens, last = c, True, capacity, None
                ok, tokens = take(tokens, last, now, price, capacity, refill)
                last = now if last is None else max(last, now)
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({"client": frame["client"], "seq": frame["seq"], "allowed": allowed, "tokens": left})

    return rows.mapInPandas(fold, f"client {rows.schema['client'].dataType.simpleString()}, seq long, allowed boolean, tokens double")


def limited_stream(calls: DataFrame, capacity: float, refill: float, idle_ms: int | None = 3_600_000) -> DataFrame:
    """The same over a stream of (client, seq, ts, cost); a client unheard of for idle_ms begins again, full.

    Spark runs batches without data as long as states may time out, so a query with trigger(availableNow=True) never
    ends; None keeps states for good, and it does.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for frame in frames:
            frame = frame.sort_values(["ts", "seq"])
            allowed, left = [], []
            for now, price in zip(frame["ts"], frame["cost"]):
                ok, tokens = take(tokens, last, now, price, capacity, refill)
                last = now if last is None else max(last, now)
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({"client": frame["client"], "seq": frame["seq"], "allowed": allowed, "tokens": left})
        state.update((tokens, last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return calls.groupBy("client").applyInPandasWithState(fold, f"client {calls.schema['client'].dataType.simpleString()}, seq long, allowed boolean, tokens double", "tokens double, last double", "append", timeout)
