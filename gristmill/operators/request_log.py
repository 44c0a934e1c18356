"""Analytics of a request log: totals, minute buckets, latency histograms and quantiles, engine savings, runs of lines."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.sequences import reuse_distances

#: Upper edges (inclusive) of the latency bins in ms; one more bin holds what is above, shown as OVERFLOW.
EDGES = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10_000, 30_000, 60_000, 120_000)
OVERFLOW = 240_000


def bin_index(ms: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Number of edges below ms."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < ms))


def histogram(ms: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Aggregate: counts of the bins, as an array; partial sums are made before the shuffle."""
    index = bin_index(ms, edges)
    return F.array(*(F.count_if(index == i) for i in range(len(edges) + 1)))


def quantile(counts: Column, q: float, edges: tuple[float, ...] = EDGES) -> Column:
    """Upper edge of the first bin up to which at least max(1, ceil(q n)) of the n values lie; 0 without values."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)
    tops = F.array(*(F.lit(float(e)) for e in (*edges, OVERFLOW)))
    want = F.greatest(F.lit(1), F.ceil(total * F.lit(q)))
    upto = lambda i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda t, x: t + x)
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(len(edges))), lambda i: upto(i) >= want), F.lit(0))
    return F.when(total == 0, 0.0).otherwise(F.get(tops, first))


def is_error(status: Column, error: Column) -> Column:
    return F.coalesce(error.isNotNull() & (error != ""), F.lit(False)) | F.coalesce(status >= 500, F.lit(False))


def saved_chars(event: Column) -> Column:
    return F.greatest(F.lit(0), event["original_chars"] - event["compressed_chars"])


def engine_savings(log: DataFrame, events: str = "events", response_events: str | None = None) -> DataFrame:
    """mode, saved: characters saved by each engine; those on responses end in -response."""
    one = log.select(F.explode(events).alias("e")).select(F.col("e.mode").alias("mode"), saved_chars(F.col("e")).alias("saved"))
    if response_events:
        other = log.select(F.explode(response_events).alias("e"))
        mode = F.when(F.endswith(F.col("e.mode"), F.lit("-response")), F.col("e.mode")).otherwise(F.concat("e.mode", F.lit("-response")))
        one = one.unionByName(other.select(mode.alias("mode"), saved_chars(F.col("e")).alias("saved")))
    return one.groupBy("mode").agg(F.sum("saved").alias("saved"))


def without_samples(events: Column) -> Column:
    """The events without their text samples."""
    return F.transform(events, lambda e: e.dropFields("sample_before", "sample_after"))


def engine_list(events: Column) -> Column:
    """Modes that saved characters, by what they saved (most first), comma-joined: a header's value."""
    modes = F.array_distinct(F.transform(events, lambda e: e["mode"]))
    total = lambda m: F.aggregate(F.filter(events, lambda e: e["mode"] == m), F.lit(0), lambda t, e: t + saved_chars(e).cast("int"))
    sums = F.filter(F.transform(modes, lambda m: F.struct((-total(m)).alias("saved"), m.alias("mode"))), lambda s: s["saved"] < 0)
    return F.array_join(F.transform(F.array_sort(sums), lambda s: s["mode"]), ",")


def minute_buckets(log: DataFrame, ts: str = "ts", ms: str = "ms", bad: Column | None = None, keep_minutes: int | None = None) -> DataFrame:
    """minute, requests, errors, total_ms, hist, p50, p95, p99; keep_minutes keeps what the newest row's time still holds."""
    bad = F.lit(False) if bad is None else bad
    out = log.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(
        F.count("*").alias("requests"), F.count_if(bad).alias("errors"), F.round(F.sum(ms), 3).alias("total_ms"), histogram(F.col(ms)).alias("hist"), F.max(ts).alias("newest")
    )
    if keep_minutes is not None:
        now = out.agg(F.max("newest").alias("now"))  # one row
        out = out.crossJoin(F.broadcast(now)).filter(F.unix_timestamp("minute") > F.floor(F.unix_timestamp("now")) - 60 * keep_minutes).drop("now")
    return out.select("minute", "requests", "errors", "total_ms", "hist", *(quantile(F.col("hist"), q).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)))


def totals(log: DataFrame, bad: Column, chars_in: Column, chars_out: Column) -> DataFrame:
    saved = F.greatest(F.lit(0), chars_in - chars_out)
    return log.agg(F.count("*").alias("requests"), F.count_if(saved > 0).alias("compacted"), F.sum(saved).alias("saved"), F.count_if(bad).alias("errors"))


def all_totals(log: DataFrame, bad: Column, saved_in: Column, saved_out: Column, bytes_in: Column, bytes_out: Column) -> DataFrame:
    """One row: requests, compacted (something was saved, in or out), errors, and sums of both directions; nulls add nothing."""
    none = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return log.agg(
        F.count("*").alias("requests"), F.count_if((none(saved_in) != 0) | (none(saved_out) != 0)).alias("compacted"), F.count_if(F.coalesce(bad, F.lit(False))).alias("errors"),
        total(none(saved_in), "saved_in"), total(none(saved_out), "saved_out"), total(F.greatest(F.lit(0), none(bytes_in)), "bytes_in"), total(F.greatest(F.lit(0), none(bytes_out)), "bytes_out"),
    )


def engine_totals(log: DataFrame, engines: Column) -> DataFrame:
    """engine, saved: sums over the maps engine -> saved characters; what isn't above 0 adds nothing."""
    each = log.select(F.explode(engines).alias("engine", "saved")).filter("saved > 0")
    return each.groupBy("engine").agg(F.sum(F.col("saved").cast("long")).alias("saved"))


def recent(log: DataFrame, n: int, ts: str = "ts", tie: str = "event_id", most: int = 200) -> DataFrame:
    """The last n (0 to most) rows, oldest first."""
    return log.orderBy(F.desc(ts), F.desc(tie)).limit(max(0, min(most, n))).orderBy(ts, tie)


def runs(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Gaps and islands: by, key, first, last, size of each run of neighbours (in order, within by) with equal keys."""
    w = Window.partitionBy(by).orderBy(order)
    begins = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = rows.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(w))
    return numbered.groupBy(by, "__run", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size")).drop("__run")


def lru_hits(accesses: DataFrame, capacity: int, order: str = "seq", key: str = "key", by: str = "cache") -> DataFrame:
    """by, order, key, hit: whether an LRU cache of capacity entries holds the key at each access: if fewer than capacity
    other keys were used since. No task holds the accesses of a cache."""
    found = reuse_distances(accesses.select(by, order, key), [order], key, by)
    return found.select(by, order, key, F.coalesce(F.col("distance") < capacity, F.lit(False)).alias("hit"))
