"""The request log as a stream: minute buckets, running costs, usage of event streams."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.request_log import histogram, quantile
from gristmill.operators.usage import AXES, FIELDS


def minute_buckets(log: DataFrame, ts: str = "ts", ms: str = "ms", bad: Column | None = None, late: str = "60 minutes") -> DataFrame:
    """minute_buckets of a stream with a watermark: rows later than that are dropped, where the batch form has them all."""
    bad = F.lit(False) if bad is None else bad
    out = log.withWatermark(ts, late).groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.round(F.sum(ms), 3).alias("total_ms"), histogram(F.col(ms)).alias("hist"))
    return out.select(F.col("window.start").alias("minute"), "requests", "errors", "total_ms", "hist", quantile(F.col("hist"), 0.95).alias("p95"))


def running_costs(costs: DataFrame) -> DataFrame:
    """Sums per provider and model so far (update or complete mode)."""
    return costs.groupBy("provider", "model").agg(F.count("*").alias("requests"), *(F.sum(a).alias(a) for a in AXES), F.round(F.sum("usd"), 6).alias("usd"))


def sse_usage(chunks: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """AXES of each stream_id after each batch of its chunks (seq, chunk): the state is the unfinished line and the largest
    numbers so far; it goes after idle_ms. None keeps it, for queries with trigger(availableNow=True): while states may time
    out, Spark runs batches without data, and such a query never ends."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def fold(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rest, *most = state.get if state.exists else (b"", 0, 0, 0, 0)
        for frame in frames:
            for chunk in frame.sort_values("seq")["chunk"]:
                *lines, rest = (bytes(rest) + bytes(chunk)).split(b"\n")
                for line in lines:
                    try:
                        event = json.loads(line.removeprefix(b"data:")) if line.startswith(b"data:") else None
                    except ValueError:
                        continue
                    if isinstance(event, dict):
                        told = [event.get("usage"), (event.get("message") or {}).get("usage") if isinstance(event.get("message"), dict) else None]
                        for u in told:
                            if isinstance(u, dict):
                                most = [max(m, x) if isinstance(x := u.get(f), int) else m for m, f in zip(most, FIELDS, strict=True)]
        state.update((bytes(rest), *most))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[key[0], *most]], columns=["stream_id", *AXES])

    numbers = ", ".join(f"{a} long" for a in AXES)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandasWithState(fold, f"stream_id {kind}, {numbers}", f"rest binary, {numbers}", "update", timeout)
