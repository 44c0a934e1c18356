"""Requests as blocks, markers and texts written back, in shapes that real requests have."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import json_edit
from gristmill.operators import blocks
from gristmill.plans import payloads


def requests(spark, *payload):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payload)], "request_id int, payload string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def user(content, **more):
    return {"messages": [{"role": "user", "content": content}], **more}


MARK = {"cache_control": {"type": "ephemeral"}}


def test_types_decide(spark):
    """A text that looks like a list is a text."""
    df = requests(
        spark, user("[INFO] started"), user([{"type": "tool_result", "content": "[2024-01-01 10:00] boom"}], system="[x]"), user([{"type": "text", "text": "{}"}, "bare", 7, {"type": "image", **MARK}]),
        user([{"type": "tool_result", "content": [{"type": "image"}, {"type": "text", "text": "[1]"}, {"type": "text", "text": 2}]}]), user("123"), {"messages": [None, 5, {"content": None}, {"role": 3, "content": "x"}], "system": 4, "tools": "[]"},
        "no json", "[1]", None, "{}", user([{"type": "tool_result", "content": [{"type": "image"}]}, {"text": "untyped"}]),
    )
    got = rows(blocks.blocks(df).withColumn("path", blocks.json_path()), "request_id", "path", "role", "text", "has_marker")
    want = [
        (0, "messages[0].content", "user", "[INFO] started", False), (1, "system", None, "[x]", False), (1, "messages[0].content[0].content", "user", "[2024-01-01 10:00] boom", False),
        (2, "messages[0].content[0].text", "user", "{}", False), (2, "messages[0].content[3].text", "user", None, True), (3, "messages[0].content[0].content[1].text", "user", "[1]", False),
        (4, "messages[0].content", "user", "123", False), (5, "messages[3].content", None, "x", False), (10, "messages[0].content[0].content", "user", None, False), (10, "messages[0].content[1].text", "user", "untyped", False),
    ]
    assert got == sorted(want, key=str)


def test_paths_lead_back_to_the_texts(spark):
    payload = json.dumps(user(["a", {"type": "text", "text": "é\n\"q\" \\u0041"}, {"type": "tool_result", "content": [{"type": "text", "text": "one"}]}, {"type": "tool_result", "content": "[t]"}], system=[{"type": "text", "text": "s"}]), indent=2)
    for r in blocks.blocks(requests(spark, payload)).withColumn("path", blocks.json_path()).collect():
        lo, hi = json_edit.spans(payload, [r.path])[r.path]
        assert json.loads(payload[lo:hi]) == r.text


@pytest.mark.parametrize("payload", ['{"a": [1, {"b": "x,]}\\"", "c": {}}], "a2" : "y" , "d":[[],["z"]]}', '{ }', '{"k":"1","k":"2"}'])
def test_spans(payload):
    def walk(v, path=""):
        yield path, v
        for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()):
            yield from walk(x, f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}".removeprefix("."))

    want = dict(walk(json.loads(payload)))
    assert {p: json.loads(payload[a:b]) for p, (a, b) in json_edit.spans(payload, want).items()} == want
    assert json_edit.spans(payload, ["none", "a[9]"]) == {}


def test_marker_on_the_last_tool_or_system(spark):
    tools = [{"name": "t1"}, {"name": "t2"}]
    sys = [{"type": "text", "text": "s1"}, {"type": "text", "text": "s2"}]
    df = requests(spark, user("q", system=sys, tools=tools), user("q", system=sys), user("q", system="[S] text"), user("q"), user([{"type": "text", "text": "x", **MARK}], tools=tools), user("q", system="", tools=[]), user("q", tools=[{}]), "bad")
    before, after = ({r.request_id: r.payload for r in d.collect()} for d in (df, payloads.marked(df)))
    new = {i: json.loads(p) for i, p in after.items() if i < 7}
    assert new[0]["tools"] == [{"name": "t1"}, {"name": "t2", **MARK}] and new[0]["system"] == sys
    assert new[1]["system"] == [sys[0], {**sys[1], **MARK}]
    assert new[2]["system"] == [{"type": "text", "text": "[S] text", **MARK}]
    assert new[6]["tools"] == [MARK]
    assert all(after[i] == before[i] for i in (3, 4, 5, 7))
    wall = blocks.with_wall(blocks.blocks(payloads.marked(df))).filter("protected").select("request_id", "kind").distinct()
    assert rows(wall, "request_id", "kind") == sorted([(0, "system"), (0, "tools"), (1, "system"), (2, "system"), (4, "message"), (4, "tools"), (6, "tools")], key=str)


def test_only_the_tail_changes(spark):
    """Up to the wall every byte stays, behind it every byte but the shortened texts."""
    odd = '{ "model" : "m","messages":[{"role":"user","content":[{"type":"text","text":"keep \\u00e9","cache_control":{}}]},\n {"role":"assistant","content":"[long] ' + "x" * 50 + '"}, {"role":"user","content":[{"type":"tool_result","content":[{"type":"text","text":"short"},{"type":"text","text":"' + "y" * 40 + '"}]},{"type":"image"},{"type":"text","text":"ab"},{"type":"tool_use","input":{"text":"' + "z" * 40 + '"}}]}]}'
    out, events = payloads.shortened_tail(requests(spark, odd, user("abcdefghijkl")), lambda t: F.substring(t, 1, 10))
    new = {r.request_id: r.payload for r in out.collect()}
    assert new[0] == odd.replace("[long] " + "x" * 50, "[long] xxx").replace("y" * 40, "y" * 10) and json.loads(new[1])["messages"][0]["content"] == "abcdefghij"
    assert rows(events, "request_id", "path", "chars_in", "chars_out", "skipped") == sorted([(0, "messages[1].content", 57, 10, None), (0, "messages[2].content[0].content[1].text", 40, 10, None), (0, "messages[2].content[2].text", 2, 2, "no_win"), (1, "messages[0].content", 12, 10, None)], key=str)


def test_near_duplicates_give_way_then_the_chain(spark):
    long = " ".join(f"word{i} other{i * 7 % 13}" for i in range(400))
    parts = [{"type": "text", "text": t} for t in (long, long + " end", '{"a":   1}', "another " * 600)]
    df = requests(spark, user(parts), user([{**parts[0], **MARK}, parts[1]], system="[sys]"))
    out, events = payloads.compact(df, {"json_aware": "standard"}, max_chars=3000)
    got = {r.request_id: [b["text"] for b in json.loads(r.payload)["messages"][0]["content"]] for r in out.collect()}
    assert len(got[0][0]) <= 3000 and got[0][1].startswith("[Near-duplicate content omitted locally. Similar to earlier block at messages[0].content[0].text; similarity=") and got[0][2] == '{"a":1}'
    assert got[1][0] == long and len(got[1][1]) <= 3000  # what stands before the wall stays, and leads none
    assert {(r.request_id, r.path[-8:-6], r.mode) for r in events.collect()} == {(0, "[0", "compacted"), (0, "[1", "near-duplicate"), (0, "[2", "compacted"), (0, "[3", "compacted"), (1, "[1", "compacted")}
    nothing = payloads.compact(df.limit(0), {})[0]
    assert nothing.count() == 0 and nothing.columns == df.columns


def test_nested_to_any_depth(spark):
    deep = [{"type": "text", "text": "a" * 40}]
    for _ in range(5):
        deep = [{"type": "tool_result", "content": deep}, "bare", {"text": "b" * 8, "content": "[c]"}]
    df = requests(spark, user(deep, system="s" * 8), user("x" * 4), user(None), "bad")
    texts = blocks.nested_texts(df)
    assert [t for (t,) in rows(texts.filter("request_id = 0"), "text")].count("[c]") == 5 and texts.agg(F.max("level")).first()[0] == 6
    assert rows(blocks.nested_tokens(texts), "request_id", "part", "tokens") == sorted([(0, "0", 10 + 5 * (1 + 2 + 1)), (0, "system", 2), (1, "0", 1)], key=str)
    assert blocks.nested_texts(df, levels=2).agg(F.max("level")).first()[0] == 2
