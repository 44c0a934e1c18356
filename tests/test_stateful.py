import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import cache, lookup
from gristmill.sources import sse
from gristmill.streaming import retained

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, retained.ROCKS)
    yield spark
    spark.conf.set(STORE, before)


def batches(spark, folder, schema, parts, make, name):
    """Rows of the stream after each of parts, one file and batch each."""
    out, seen = [], 0
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        found = spark.read.parquet(f"{folder}/out").collect()
        out.append(found)
    return out


LOG = "log string, seq long, ts double, ms double, bad boolean"


def test_retention_with_a_late_row(rocks, tmp_path):
    """Minute 0 goes when minute 3 comes; a late row makes it anew, and it stays until a newer row lets it go."""
    parts = [
        [("a", 0, 5.0, 3.0, False), ("a", 1, 65.0, 3.0, True), ("b", 2, 0.0, 1.0, False)],
        [("a", 3, 185.0, 9.0, False), ("a", 4, 10.0, 200_000.0, False)],
        [("a", 5, 190.0, 1.0, False)],
    ]
    found = batches(rocks, tmp_path, LOG, parts, lambda s: retained.retained_minutes(s, 2), "minutes")
    told = [sorted((r.log, r.minute, r.requests, r.errors, r.kept) for r in rows) for rows in found]
    first = [("a", 0, 1, 0, True), ("a", 60, 1, 1, True), ("b", 0, 1, 0, True)]
    second = [("a", 0, 1, 0, True), ("a", 60, 0, 0, False), ("a", 180, 1, 0, True)]  # 60 <= 185 - 120; 0 is there again
    third = [("a", 0, 0, 0, False), ("a", 180, 2, 0, True)]
    assert told == [sorted(first), sorted(first + second), sorted(first + second + third)]
    late = [r for r in found[1] if r.minute == 0 and r.log == "a" and r.total_ms == 200_000.0]
    assert late[0].hist[-1] == 1 and sum(late[0].hist) == 1


def test_a_client_too_many_lets_the_oldest_go(rocks, tmp_path):
    schema = "client string, seq long, ts double, cost double"
    parts = [
        [("x", 0, 0.0, 2.0), ("y", 1, 0.0, 2.0), ("x", 2, 0.0, 1.0), ("z", 3, 0.0, 2.0)],  # y is the oldest when z comes
        [("y", 4, 0.0, 2.0), (None, 5, 0.0, 3.0), ("x", 6, 0.0, 1.0)],  # y is full again; then x has gone, and is full
    ]
    make = lambda s: retained.capped_limiter(s, 2.0, 0.001, max_clients=2)
    rows = batches(rocks, tmp_path, schema, parts, make, "limiter")[-1]
    assert {r.seq: r.allowed for r in rows} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True}
    with pytest.raises(ValueError):
        retained.capped_limiter(rocks.createDataFrame([], schema), 0, 1)


def test_states_need_their_store(spark):
    with pytest.raises(ValueError, match="providerClass"):
        retained.retained_minutes(spark.createDataFrame([], LOG), 2)


def test_every_cut_gives_the_same_events(spark):
    """A stream cut at any two bytes, in characters and line ends too, has the same events."""
    said = 'data: {"é": "😀"}\r\n\r\ndata: [DONE]\ndata:{bad\n: note\ndata: {"usage": {"input_tokens": 3}}\ndata: {"last": 1}'.encode()
    rows, n = [], 0
    for i, j in [*itertools.combinations(range(0, len(said), 6), 2), (0, 0), (0, len(said))]:
        rows += [(n, 0, said[:i]), (n, 1, said[i:j]), (n, 2, None if i == 0 else b""), (n, 3, said[j:])]
        n += 1
    rows += [(n, k, said[k : k + 1]) for k in range(len(said))]
    random.Random(0).shuffle(rows)
    found: dict = {}
    for r in sse.events(spark.createDataFrame(rows, "stream_id int, seq int, chunk binary")).collect():
        found.setdefault(r.stream_id, []).append((r.at, r.data))
    want = [(0, '{"é": "😀"}'), (5, '{"usage": {"input_tokens": 3}}'), (6, '{"last": 1}')]
    assert len(found) == n + 1 and all(sorted(x) == want for x in found.values())


DELTA = "op string, cache_key string, ts double, seq long, status_code int, headers map<string,string>, body binary, media_type string"


def delta(op, key=None, ts=0.0, seq=0, body=None, status=200):
    return op, key, ts, seq, status, {"Set-Cookie": "s", "A": "b"} if op == "put" else None, body, "text" if op == "put" else None


def entries(df):
    return {r.cache_key: (bytes(r.body), r.inserted_at, r.last_hit_at, r.hit_count) for r in df.collect()}


def test_cache_versions(spark, tmp_path):
    table = cache.CacheTable(spark, str(tmp_path / "cache"), most=2)
    assert table.current().count() == 0
    steps = [
        [delta("put", "a", 1.0, body=b"1"), delta("hit", "a", 2.0), delta("hit", "a", 0.5), delta("put", "b", 3.0, body=b"2"), delta("put", "bad", 3.0, body=b"x", status=500), delta("hit", "none", 9.0)],
        [delta("hit", "a", 4.0), delta("put", "c", 5.0, body=b"3"), delta("put", "b", 3.5, body=b"22")],
        [delta("put", "a", 6.0, 1, b"9"), delta("put", "a", 6.0, 2, b"10"), delta("hit", "a", 6.0, 3)],
        [delta("put", "d", 7.0, body=b"4"), delta("purge", ts=8.0), delta("hit", "a", 9.0), delta("put", "e", 9.0, body=b"5")],
    ]
    want = [
        {"a": (b"1", 1.0, 2.0, 1), "b": (b"2", 3.0, 3.0, 0)}, {"c": (b"3", 5.0, 5.0, 0), "a": (b"1", 1.0, 4.0, 2)},
        {"c": (b"3", 5.0, 5.0, 0), "a": (b"10", 6.0, 6.0, 1)}, {"e": (b"5", 9.0, 9.0, 0)},
    ]
    for i, (step, state) in enumerate(zip(steps, want)):
        for _ in range(2):  # a batch that comes again changes nothing
            table.merge(spark.createDataFrame(step, DELTA), i)
        assert entries(table.current()) == state
    assert table.versions() == [2, 3] and table.current().first().headers == {"A": "b"}


def test_cache_fed_by_a_stream(spark, tmp_path):
    table = cache.CacheTable(spark, str(tmp_path / "cache"), most=5)
    spark.createDataFrame([delta("put", f"k{i}", float(i), body=b"x") for i in range(9)], DELTA).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(DELTA).parquet(str(tmp_path / "in")).writeStream.foreachBatch(table.merge).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(entries(table.current())) == [f"k{i}" for i in range(4, 9)]


def test_policy_document(spark):
    text = json.dumps({"default": {"jl_dedupe": True}, "rules": [{"model_glob": "claude-opus-*", "endpoint": "v1/messages", "policy": {"caveman_enabled": True}}, {"model_glob": "gpt*"}]})
    rules = lookup.policies(text)
    assert rules == [("claude-opus-*", "v1/messages", '{"caveman_enabled": true}'), ("gpt*", "*", "{}"), ("*", "*", '{"jl_dedupe": true}')]
    rows = spark.createDataFrame([("claude-opus-4", "v1/messages"), ("claude-opus-4", "other"), (None, "v1/messages"), ("gpt-4", "x")], "model string, endpoint string")
    assert [r.policy for r in lookup.first_rule(rows, rules).collect()] == ['{"caveman_enabled": true}', '{"jl_dedupe": true}', '{"jl_dedupe": true}', "{}"]
    assert lookup.policies(" ") == [("*", "*", "{}")]
    for bad in ("5", '{"rules": {}}', '{"rules": [1]}', '{"default": {"no_such": 1}}', "{"):
        with pytest.raises(ValueError):
            lookup.policies(bad)
