import random
from collections import OrderedDict

import numpy as np
import pytest

from gristmill.operators import request_log, sequences, usage


def test_smaller_before():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 100, 257):
        values = rng.integers(0, max(1, n // 2), n)
        assert sequences.smaller_before(values).tolist() == [int((values[:i] < v).sum()) for i, v in enumerate(values)]


@pytest.mark.parametrize(("chunks", "parts"), [(1, None), (3, 5), (1024, 2)])
def test_reuse_distances(spark, chunks, parts):
    """Against a replay, with a key that holds a third of the rows and null keys and caches."""
    rng = random.Random(chunks)
    rows = [(rng.choice(["a", "b", None]), i * 3, rng.choice([*range(12), 0, 0, 0, 0, None, None])) for i in range(700)]
    found = sequences.reuse_distances(spark.createDataFrame(rows, "cache string, seq long, key int"), ["seq"], chunks=chunks, parts=parts).collect()
    last: dict = {}
    want = {}
    for cache, seq, key in rows:
        stack = last.setdefault(cache, OrderedDict())
        want[cache, seq] = list(reversed(stack)).index(key) if key in stack else None
        stack[key] = None
        stack.move_to_end(key)
    assert len(found) == 700 and {(r.cache, r.seq): r.distance for r in found} == want


def test_no_accesses(spark):
    none = spark.createDataFrame([], "cache string, seq long, key int")
    assert request_log.lru_hits(none, 3).collect() == [] and usage.running_budget(none.withColumnRenamed("key", "chars"), 5).collect() == []


def test_running_sums_have_no_task_with_all_rows(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, ["x", "y", None][i % 3 if i % 2 else 0]) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, chars int, who string").repartition(5)
    for by in (None, "who"):
        total: dict = {}
        want = {}
        for seq, chars, who in rows:
            k = who if by else 0
            total[k] = total.get(k, 0) + (chars or 0)
            want[seq] = (total[k], max(0, 300 - total[k]), total[k] >= 300)
        out = usage.running_budget(df, 300, by=by)
        assert {r.seq: (r.used, r.remaining, r.exceeded) for r in out.collect()} == want
        for parts in (1, 4, 9):
            out = sequences.running_sums(df, {"used": "chars"}, ["seq"], [by] if by else [], parts)
            assert {r.seq: r.used for r in out.collect()} == {seq: used for seq, (used, *_) in want.items()}
    assert sequences.in_parts(df, "seq", parts=4).select(sequences.PART).distinct().count() == 4
