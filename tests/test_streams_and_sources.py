import hashlib
import json
import time

from pyspark.sql import functions as F

from gristmill.functions import sketch, text
from gristmill.operators import blocks, limits, lookup, near_dup, usage
from gristmill.plans.compaction import compacted
from gristmill.sources import logs, sse
from gristmill.streaming import log_stream

CHUNKS = [
    ("a", 0, b'data: {"message": {"usage": {"input_tokens": 7}}}\r\nda'),
    ("a", 1, b'ta: {"usage": {"output_tokens": 3}}\n\ndata: [DONE]\ndata: {bad\n'),
    ("a", 2, b'data: {"usage": {"output_tokens": 9, "input_tokens": -4}}\n'),
    ("b", 0, b": comment\n"),
]


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return stream.sparkSession.table(name).collect()


def test_sse_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(CHUNKS, "stream_id string, seq int, chunk binary")
    got = {r.stream_id: (r.input_tokens, r.output_tokens) for r in sse.usage(df).collect()}
    assert got == {"a": (7, 9)}
    df.write.parquet(str(tmp_path / "in"))
    rows = run(log_stream.sse_usage(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), idle_ms=None), "sse", "update")
    assert {(r.stream_id, r.input_tokens, r.output_tokens) for r in rows} == {("a", 7, 9), ("b", 0, 0)}


def test_limits_batch_and_stream(spark, tmp_path):
    calls = spark.createDataFrame([("x", 0, 0.0, 2), ("x", 1, 0.0, 2), ("x", 2, 10.0, 1), ("x", 3, 10.0, 0), ("y", 4, 0.0, 3)], "client string, seq long, ts double, cost int")
    want = {0: True, 1: False, 2: True, 3: True, 4: True}
    assert {r.seq: r.allowed for r in limits.limited(calls, 3, 0.1).collect()} == want
    calls.write.parquet(str(tmp_path / "in"))
    rows = run(limits.limited_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")), 3.0, 0.1, idle_ms=None), "limits", "append")
    assert {r.seq: r.allowed for r in rows} == want


def test_idle_states_go(spark, tmp_path):
    calls = lambda *rows: spark.createDataFrame(rows, "client string, seq long, ts double, cost int")
    calls(("x", 0, 0.0, 3)).write.parquet(str(tmp_path / "in"))
    stream = limits.limited_stream(spark.readStream.schema(calls().schema).parquet(str(tmp_path / "in")), 3.0, 0.0, idle_ms=1)
    q = stream.writeStream.format("memory").queryName("idle").outputMode("append").start()
    told = lambda: {r.seq: r.allowed for r in spark.table("idle").collect()}
    try:
        for seq, wait in ((0, 2), (1, 0)):
            end = time.time() + 60
            while seq not in told() and time.time() < end:
                time.sleep(0.2)
            time.sleep(wait)  # batches without data run meanwhile, and the state times out
            if seq == 0:
                calls(("x", 1, 0.0, 3)).write.mode("append").parquet(str(tmp_path / "in"))
        assert told() == {0: True, 1: True}
    finally:
        q.stop()


def test_minute_stream(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:10' + make_interval(0,0,0,0,0,i) AS ts, cast(i AS double) * 100 AS ms FROM range(3) AS t(i)")
    df.write.parquet(str(tmp_path / "in"))
    rows = run(log_stream.minute_buckets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "minutes", "complete")
    assert sorted((r.minute.minute, r.requests, r.p95) for r in rows) == [(0, 1, 1.0), (1, 1, 100.0), (2, 1, 250.0)]


def test_log_and_captures(spark, tmp_path):
    row = {"ts": 1.5, "method": "POST", "path": "/v1/messages", "status": 200, "request_id": "r", "model": "m", "ms": 2.0, "events": [{"path": "p", "mode": "a", "original_chars": 9, "compressed_chars": 4, "sha256": "s"}]}
    log = spark.createDataFrame([json.dumps(row)], "string").select(F.from_json("value", logs.LOG_DDL).alias("x")).select("x.*")
    logs.append_log(log, str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log")).collect()[0].events[0].original_chars == 9
    req = spark.createDataFrame([(1.0, "POST", "/v1/messages", {"Authorization": "x", "A": "b"}, b"body", 200)], "ts double, method string, path string, headers map<string,string>, body binary, status int")
    logs.write_captures(req, str(tmp_path / "cap"))
    (c,) = logs.read_captures(spark, str(tmp_path / "cap")).collect()
    assert c.headers == {"Authorization": "<redacted>", "A": "b"} and bytes(c.body) == b"body" and c.body_sha256 == hashlib.sha256(b"body").hexdigest()
    bodies = spark.createDataFrame([("POST", "/v1/messages", None, b' {"a": 1}'), ("GET", "/v1/messages", "application/json", b"{}"), ("POST", "/v1/messages", "application/json", b"{x")], "method string, path string, content_type string, body binary")
    assert sorted(str(r.payload) for r in logs.json_requests(bodies).collect()) == [' {"a": 1}', "None"]


def test_metrics_text(spark):
    rows = spark.createDataFrame([("m_total", "counter", "All", "engine", 'a"b', 2.0), ("m_total", "counter", "All", "engine", "b", 1.5)], "name string, kind string, help string, label_name string, label_value string, value double")
    assert [r.line for r in logs.metrics_text(rows).orderBy("name", "line_no").collect()] == ["# HELP m_total All", "# TYPE m_total counter", 'm_total{engine="a\\"b"} 2', 'm_total{engine="b"} 1.5']


def test_blocks_and_wall(spark):
    payload = {
        "system": [{"type": "text", "text": "sys", "cache_control": {"type": "ephemeral"}}],
        "messages": [{"role": "user", "content": "plain"}, {"role": "assistant", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "one"}, {"type": "text", "text": "longer"}]}, {"type": "text", "text": "t"}]}, {"role": "user", "content": None}],
    }
    rows = blocks.blocks(spark.createDataFrame([("r", json.dumps(payload))], "request_id string, payload string"))
    got = {(r.kind, r.msg_idx, r.block_idx, r.sub_idx, r.text): r.protected for r in blocks.with_wall(rows).collect()}
    assert got == {("system", None, 0, None, "sys"): True, ("message", 0, 0, None, "plain"): False, ("message", 1, 0, 0, "one"): False, ("message", 1, 0, 1, "longer"): False, ("message", 1, 1, None, "t"): False}
    assert [r.text for r in blocks.largest_sub(rows.filter("block_type = 'tool_result'")).collect()] == ["longer"]
    assert blocks.token_totals(rows).filter("total").first().tokens == 6


def test_prices_policies_usage(spark):
    rows = spark.createDataFrame([("anthropic", "claude-3-opus-1", 1_000_000, 0, -5, 10), ("openai", "gpt-4o-mini", 10, 10, 0, 0), ("local", "x", 5, 5, 5, 5), ("none", "x", 1, 1, 1, 1)], "provider string, model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
    got = {r.provider: (r.usd, r.matched) for r in usage.priced(rows, lookup.prices(spark)).collect()}
    assert got == {"anthropic": (15.000015, True), "openai": (7.5e-06, True), "local": (0.0, True), "none": (0.0, False)}
    body = spark.createDataFrame([('{"usage": {"input_tokens": 3, "output_tokens": -1}}',), ("no json",), (None,)], "b string").select(usage.usage(F.col("b")).alias("u")).collect()
    assert [tuple(r.u) for r in body] == [(3, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert lookup.policies('[{"model_glob": "a*", "policy": {"rtk_level": "minimal"}}]') == [("a*", "*", '{"rtk_level": "minimal"}')]


def test_blake_sketches(spark):
    df = spark.createDataFrame([("one two three four five six",), ("",)], "t string").select(text.shingles(text.words(F.col("t")), 5).alias("s"))
    rows = df.select(sketch.minhash_blake2b(F.col("s"), "seed", 4).alias("m"), sketch.minhash_personal(F.col("s"), 4).alias("p"), sketch.simhash_blake2b(F.col("s"), "seed").alias("h"), sketch.projection_blake2b(F.col("s"), "seed", 8).alias("v")).collect()
    heads = [b"seed\x00" + i.to_bytes(4, "big") for i in range(4)]
    grams = [b"one two three four five", b"two three four five six"]
    want = [min(int.from_bytes(hashlib.blake2b(h + g, digest_size=8).digest(), "big") for g in grams) for h in heads]
    assert [x % 2**64 for x in rows[0].m] == want and abs(sum(x * x for x in rows[0].v) - 1) < 1e-9
    assert [x % 2**64 for x in rows[1].m] == [2**64 - 1] * 4 and rows[1].p == [0] * 4 and rows[1].h == 0 and set(rows[1].v) == {0.0}


def test_leaders_by_hand(spark):
    rows = spark.createDataFrame([("g", i, i == 3) for i in range(5)], "grp string, id long, safe boolean")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.95), (0, 3, 0.9), (3, 4, 0.8), (0, 4, 0.85)], "a long, b long, sim double")
    got = {r.id: r.leader for r in near_dup.leaders(rows, pairs, protected_col="safe").collect()}
    assert got == {0: None, 1: 0, 2: None, 3: None, 4: 0}


def test_compaction(spark):
    rows = spark.createDataFrame([(1, "In order to see the function. " * 20), (2, None), (3, "x" * 15_000)], "id int, text string")
    got = {r.id: r.compacted for r in compacted(rows, {"caveman": "standard", "rtk": "minimal"}).collect()}
    assert got[1].startswith("to see fn.") and got[2] is None and len(got[3]) < 12_100 and "omitted" in got[3]


def test_entry_without_optional_parts():
    import __spark_entry__

    assert "near_dup_pairs" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
