"""Functions whose results SQL can't give, and cases that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import sketch, text
from gristmill.operators import blocks, lookup


def test_pseudo_embedding(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown fix"), (3, "zzzz"), (4, ""), (5, "a"), (6, None)], "id int, t string")
    got = {r.id: r.e for r in rows.select("id", sketch.pseudo_embedding(F.col("t"), 64).alias("e")).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    assert got[6] is None and all(len(got[i]) == 64 and abs(dot(got[i], got[i]) - 1) < 1e-9 for i in range(1, 6))
    assert dot(got[1], got[2]) > 0.5 > dot(got[1], got[3])
    assert got[4] != got[5]
    with pytest.raises(ValueError):
        sketch.pseudo_embedding(F.col("t"), 8)


def test_policies():
    rules = lookup.policies(json.dumps([{"model_glob": "a*", "policy": {"caveman_enabled": True, "max_text_chars": 5}}, {"endpoint": "count"}]))
    assert [r[:2] for r in rules] == [("a*", "*"), ("*", "count")] and json.loads(rules[0][2])["max_text_chars"] == 5
    for bad in ({"lingua": "on"}, {"max_text_chars": -1}):
        with pytest.raises(ValueError):
            lookup.policies(json.dumps([{"policy": bad}]))


def test_context_window(spark):
    rows = spark.createDataFrame([("claude-3-opus-1",), ("other",), (None,)], "m string")
    assert [r[0] for r in rows.select(lookup.context_window(F.col("m"), [("claude", 1), ("claude-3", 2)], 7)).collect()] == [2, 7, 7]


def test_iso_utc_ignores_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(0.0,), (1710054000.5,), (None,)], "s double")
        assert [r[0] for r in rows.select(text.iso_utc(F.col("s"))).collect()] == ["1970-01-01T00:00:00+00:00", "2024-03-10T07:00:00.500000+00:00", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_serialised_chars(spark):
    rows = spark.createDataFrame([('{"a": [1, 2], "b": "\\u00e9"}',), ("not json",), (None,)], "p string")
    assert [r[0] for r in rows.select(text.serialised_chars(F.col("p"))).collect()] == [len('{"a":[1,2],"b":"é"}'), 8, None]


def test_prefix_unchanged(spark):
    rows = spark.createDataFrame([("abcd", "abcd ef", True), ("abcd", "abXd", True), ("abcd", "abXd", False)], "a string, b string, m boolean")
    kept = lambda *n: [r[0] for r in rows.select(blocks.prefix_unchanged(F.col("a"), F.col("b"), F.col("m"), *n)).collect()]
    assert kept() == [True, False, True]
    assert kept(F.lit(2)) == [True, True, True]
