"""Request bodies, logs and captures as tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.cache import redacted

LOG_DDL = """ts double, method string, path string, status int, request_id string, model string, ms double, bytes_in bigint, bytes_out bigint, error string,
events array<struct<path:string,mode:string,original_chars:int,compressed_chars:int,sha256:string>>"""
CAPTURE_DDL = "capture_id string, ts double, method string, path string, headers map<string,string>, body_base64 string, body_sha256 string, status int"


def json_requests(rows: DataFrame, endpoints: tuple[str, ...] = ("/v1/messages", "/v1/messages/count_tokens")) -> DataFrame:
    """rows (method, path, content_type, body binary) that are JSON posts to the endpoints, with payload (text); the cheap
    tests come before any parsing. payload is null where the body is no JSON."""
    text = F.decode("body", "UTF-8")
    is_json = F.coalesce(F.lower("content_type").contains("json"), F.lit(False)) | F.ltrim(text).rlike(r"^[{\[]")
    out = rows.filter((F.upper("method") == "POST") & F.col("path").isin(*endpoints)).filter(is_json)
    return out.withColumn("payload", F.when(F.try_parse_json(text).isNotNull(), text))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines request log, by its fixed schema: no inference pass; lines that are no JSON become nulls."""
    return spark.read.schema(LOG_DDL).json(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def stream_log(log: DataFrame, path: str, checkpoint: str):
    return log.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_lines(log: DataFrame) -> DataFrame:
    """One JSON text per row, for a console or text sink."""
    return log.select(F.to_json(F.struct("*")).alias("value"))


def captures(requests: DataFrame) -> DataFrame:
    """Capture rows: headers redacted, body as base64 with its SHA-256."""
    return requests.select(
        F.concat_ws("-", F.date_format(F.timestamp_seconds("ts"), "yyyyMMdd'T'HHmmss"), F.substring(F.sha2("body", 256), 1, 12)).alias("capture_id"),
        "ts", "method", "path", redacted(F.col("headers")).alias("headers"), F.base64("body").alias("body_base64"), F.sha2("body", 256).alias("body_sha256"), "status",
    )


def write_captures(requests: DataFrame, path: str) -> None:
    captures(requests).write.mode("append").json(path)


def read_captures(spark: SparkSession, path: str, capture_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(CAPTURE_DDL).json(path).withColumn("body", F.unbase64("body_base64"))
    return rows if capture_id is None else rows.filter(F.col("capture_id") == capture_id)


def newest_captures(rows: DataFrame, most: int) -> DataFrame:
    """The newest most captures (0: none), by time and id."""
    return rows.orderBy(F.desc("ts"), F.desc("capture_id")).limit(most)


def label(value: Column) -> Column:
    """Escaped for a label of the metrics text format."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metrics_text(values: DataFrame) -> DataFrame:
    """Lines of the metrics text format from rows (name, kind, help, label_name, label_value, value): each name once with
    its help and type, then its values in order. Columns: name, line_no, line."""
    labels = F.when(F.col("label_name").isNotNull(), F.concat(F.lit("{"), "label_name", F.lit('="'), label(F.col("label_value")), F.lit('"}'))).otherwise("")
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    w = Window.partitionBy("name").orderBy(F.col("label_value").asc_nulls_first())
    rows = values.withColumn("at", F.row_number().over(w))
    head = F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind"))
    lines = F.concat(F.when(F.col("at") == 1, head).otherwise(F.array().cast("array<string>")), F.array(F.concat("name", labels, F.lit(" "), number)))
    return rows.select("name", "at", F.posexplode(lines).alias("i", "line")).select("name", F.when(F.col("at") == 1, F.col("i")).otherwise(F.col("at") + 1).alias("line_no"), "line")


#: The series of a service, in their order: column of the totals (or of the settings), name, kind, help.
COUNTERS = [
    ("requests", "requests_total", "Requests seen."), ("compacted", "compressed_requests_total", "Requests that something was saved on."), ("errors", "upstream_errors_total", "Requests that failed."),
    ("saved_in", "chars_saved_in_total", "Characters saved on requests."), ("saved_out", "chars_saved_out_total", "Characters saved on responses."), ("protected", "protected_blocks_total", "Blocks left alone before a marker."),
    ("hits", "cache_hits_total", "Texts found rewritten before."), ("misses", "cache_misses_total", "Texts that had to be rewritten."),
]
GAUGES = [("uptime_s", "uptime_seconds", "Seconds since the start."), ("size", "cache_size", "Entries held."), ("max_entries", "cache_max_entries", "Entries that are held at most.")]
REAL = ("uptime_s", "similarity")  #: shown with six decimals


def exposition(totals: DataFrame, engines: DataFrame, switches: DataFrame, prefix: str = "gristmill") -> DataFrame:
    """at, line: all series in the metrics text format, in one order.

    totals is one row with the columns of COUNTERS and GAUGES and similarity (missing ones and nulls are 0), engines has
    engine and saved (a counter for each), switches has family (input, engine or feature), place, name and enabled (a gauge
    of 0 or 1 for each, in order of place). The few series are unpivoted and ordered at the end; nothing else is held."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in totals.columns else F.lit(0.0)
    shown = lambda c: F.format_string("%.6f", value(c)) if c in REAL else value(c).cast("long").cast("string")
    kinds = [(i, c, n, "counter", h) for i, (c, n, h) in enumerate(COUNTERS)] + [(100 + i, c, n, "gauge", h) for i, (c, n, h) in enumerate(GAUGES)]
    kinds.append((600, "similarity", "similarity_threshold", "gauge", "Similarity from which texts are near-duplicates."))
    lit = lambda x: F.lit(x).cast("string")
    row = lambda i, name, kind, told, label, of, v: F.struct(F.lit(i).alias("family"), lit(name).alias("name"), lit(kind).alias("kind"), lit(told).alias("help"), lit(label).alias("label"), of.alias("of"), v.alias("value"))
    plain = totals.select(F.explode(F.array(*(row(i, n, k, h, None, lit(None), shown(c)) for i, c, n, k, h in kinds))).alias("s"), F.lit(0).alias("place"))
    saved_ = engines.select(row(500, "engine_chars_saved_total", "counter", "Characters saved by each engine.", "engine", F.col("engine"), F.col("saved").cast("string")).alias("s"), F.lit(0).alias("place"))
    families = [(200, "input", "input_compression_enabled", "Whether requests are compacted.", "engine"), (300, "engine", "engine_enabled", "Whether an engine is on.", "engine"), (400, "feature", "feature_enabled", "Whether a feature is on.", "feature")]
    out = plain.unionByName(saved_)
    for i, family, name, told, label_name in families:
        out = out.unionByName(switches.filter(F.col("family") == family).select(row(i, name, "gauge", told, label_name, F.col("name"), F.when(F.coalesce("enabled", F.lit(False)), "1").otherwise("0")).alias("s"), F.col("place").cast("int").alias("place")))
    rows = out.select("s.*", "place")
    first = F.row_number().over(Window.partitionBy("family").orderBy("place", "of")) == 1
    full = F.concat(F.lit(f"{prefix}_"), "name")
    labels = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("{"), "label", F.lit('="'), label(F.coalesce("of", F.lit(""))), F.lit('"}')))
    head = F.array(F.concat(F.lit("# HELP "), full, F.lit(" "), "help"), F.concat(F.lit("# TYPE "), full, F.lit(" "), "kind"))
    lines = F.concat(F.when(first, head).otherwise(F.array().cast("array<string>")), F.array(F.concat(full, labels, F.lit(" "), "value")))
    rows = rows.withColumn("lines", lines).select("family", "place", "of", F.posexplode("lines").alias("i", "line"))
    return rows.select((F.row_number().over(Window.orderBy("family", "place", "of", "i")) - 1).alias("at"), "line")
