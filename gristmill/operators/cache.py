"""Response caching as joins: cache keys, admission, exact lookups, statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.sequences import running_sums

#: Headers whose values are hidden in captures, and headers that aren't stored with a cached response.
HIDDEN = ("authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization")
UNSTORED = ("content-length", "transfer-encoding", "connection", "content-encoding", "set-cookie")


def canonical(payload: Column, dropped: Iterable[str] = ("metadata",)) -> Column:
    """Compact JSON with sorted keys at every depth, without the dropped top-level keys; what is no JSON object is
    wrapped as its own text. Numbers and strings come through as written, so this runs in Arrow batches."""
    gone = frozenset(dropped)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        value = {k: v for k, v in value.items() if k not in gone} if isinstance(value, dict) else {"_raw": text}
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return of(payload)


def cache_key(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def cacheable(method: Column, path: Column, stream: Column, payload: Column) -> Column:
    """A messages request by POST that isn't streamed and whose payload could be read."""
    return F.coalesce((F.upper(method) == "POST") & F.endswith(path, F.lit("/messages")) & ~F.coalesce(stream, F.lit(False)) & payload.isNotNull(), F.lit(False))


def admitted(status: Column, body_bytes: Column, most: int) -> Column:
    return F.coalesce(status.between(200, 299) & (body_bytes <= most), F.lit(False))


def redacted(headers: Column, hidden: Iterable[str] = HIDDEN) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*hidden), "<redacted>").otherwise(v))


def stored_headers(headers: Column, dropped: Iterable[str] = UNSTORED) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*dropped))


def lookups(requests: DataFrame, entries: DataFrame, key: str = "cache_key") -> DataFrame:
    """requests with the entry of the same key, if there is one, and hit."""
    return requests.join(entries.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def touched(entries: DataFrame, hits: DataFrame, key: str = "cache_key", ts: str = "ts") -> DataFrame:
    """entries after the hits (key, ts): last_hit_at and hit_count brought up to date."""
    seen = hits.groupBy(key).agg(F.max(ts).alias("__last"), F.count("*").alias("__n"))
    out = entries.join(seen, key, "left")
    out = out.withColumn("last_hit_at", F.greatest("last_hit_at", "__last")).withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0)))
    return out.drop("__last", "__n")


def evicted(entries: DataFrame, most: int) -> DataFrame:
    """entries without the least recently used beyond most (0 or less: none go). Keys are ranked part by part, so that
    no task holds all that stay."""
    if most <= 0:
        return entries
    keys = entries.select("cache_key", "last_hit_at", "inserted_at", F.lit(1).alias("__one"))
    ranked = running_sums(keys, {"__rank": "__one"}, [F.desc_nulls_last("last_hit_at"), F.desc("inserted_at"), F.asc("cache_key")])
    return entries.join(ranked.filter(F.col("__rank") <= most).select("cache_key"), "cache_key", "left_semi").select(*entries.columns)


ENTRY = "cache_key string, status_code int, headers map<string,string>, body binary, media_type string, inserted_at double, last_hit_at double, hit_count long, body_bytes long"
_STORED = ["status_code", "headers", "body", "media_type"]


def merged(entries: DataFrame, deltas: DataFrame, most: int = 0, max_body_bytes: int = 1 << 20) -> DataFrame:
    """entries (ENTRY) after deltas (op: put, hit or purge; cache_key, ts, seq, and for a put status_code, headers, body and
    media_type), in order of ts and seq; then the least recently used beyond most go.

    A purge empties the cache. A put replaces the entry and its counts; one of another status than 2xx, or too large, is
    passed over. A hit counts for the entry that is there, if there is one. The newest put of a key and its hits are
    found by aggregates that begin before the shuffle, so that a key with many hits is a few rows."""
    when = F.struct("ts", "seq")
    purged = deltas.filter("op = 'purge'").agg(F.max(when).alias("purged"))  # one row
    since = deltas.crossJoin(F.broadcast(purged)).filter((F.col("op") != "purge") & (F.col("purged").isNull() | (when > F.col("purged"))))
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    good = (F.col("op") == "put") & F.col("status_code").between(200, 299) & (size <= max_body_bytes)
    puts = since.filter(good).groupBy("cache_key").agg(F.max(when).alias("put_at"))
    hits = since.filter("op = 'hit'").select("cache_key", when.alias("at")).join(puts, "cache_key", "left").filter(F.col("put_at").isNull() | (F.col("at") > F.col("put_at")))
    hits = hits.groupBy("cache_key").agg(F.count("*").alias("__n"), F.max("at.ts").alias("__last"))
    new = since.filter(good).withColumn("at", when).join(puts.withColumnRenamed("put_at", "at"), ["cache_key", "at"]).dropDuplicates(["cache_key"])
    new = new.select("cache_key", *_STORED, F.col("ts").alias("inserted_at"), F.col("ts").alias("last_hit_at"), F.lit(0).cast("long").alias("hit_count"), size.cast("long").alias("body_bytes"))
    new = new.withColumn("headers", stored_headers(F.col("headers")))
    old = entries.crossJoin(F.broadcast(purged)).filter("purged is null").drop("purged").join(puts.select("cache_key"), "cache_key", "left_anti")
    every = old.select(*new.columns).unionByName(new).join(hits, "cache_key", "left")
    every = every.withColumn("last_hit_at", F.greatest("last_hit_at", "__last")).withColumn("hit_count", F.col("hit_count") + F.coalesce("__n", F.lit(0)))
    return evicted(every.select(*[f.split()[0] for f in ENTRY.replace("map<string,string>", "m").split(", ")]), most)


class CacheTable:
    """Entries as versions in a folder: each merge writes the next version whole, readers take the newest complete one.

    A batch that comes again (a restarted stream) finds its version and writes nothing. Versions before the last two are
    deleted."""

    def __init__(self, spark: SparkSession, path: str, most: int = 0) -> None:
        self.spark, self.path, self.most = spark, path.rstrip("/"), most

    def _folder(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, at = self._folder()
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        found = sorted(int(n.removeprefix("v")) for n in names if n.startswith("v"))
        return [v for v in found if files.exists(self._folder(f"v{v}/_SUCCESS")[1])]

    def current(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], ENTRY)

    def merge(self, deltas: DataFrame, batch: int) -> None:
        done = self.versions()
        if batch in done or done and done[-1] > batch:
            return
        merged(self.current(), deltas, self.most).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        for old in done[:-1]:
            files, at = self._folder(f"v{old}")
            files.delete(at, True)


def stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("body_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


def encoded_body(body: Column) -> Column:
    return F.base64(body)


def decoded_body(text: Column) -> Column:
    return F.unbase64(text)
