import os

import numpy as np
import pytest

from gristmill.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, score string, query_id int"


def brute(ids, rows, q, own, k):
    d = np.sqrt(((rows - q) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("n,ties", [(1, False), (3, True), (700, False), (900, True)])
def test_factor_one_is_exact(n, ties):
    rng = np.random.default_rng(n)
    rows = rng.normal(size=(n, 6)) if not ties else rng.integers(0, 3, size=(n, 6)).astype(float)
    ids = rng.permutation(5 * n)[:n].astype(np.int64)
    d, who = vptree.VpTree(ids, rows, leaf=8).search(rows[:50], ids[:50], 10, 1.0)
    for i in range(min(n, 50)):
        want = brute(ids, rows, rows[i], ids[i], 10)
        assert [int(x) for x, y in zip(who[i], d[i]) if np.isfinite(y)] == [x for x, _ in want]
        assert np.allclose([y for y in d[i] if np.isfinite(y)], [y for _, y in want])


def test_a_larger_factor_looks_at_less():
    rng = np.random.default_rng(5)
    rows = np.repeat(rng.normal(size=(40, 32)) * 4, 50, 0) + rng.normal(size=(2000, 32))
    ids = np.arange(2000)
    seen = []
    for factor in (1.0, 1.3, 3.0):
        tree = vptree.VpTree(ids, rows, leaf=32)
        tree.search(rows[::20], ids[::20], 10, factor)
        seen.append(tree.looked)
    assert seen[0] >= seen[1] > seen[2] and seen[0] < 100 * 2000


def test_table(spark):
    bad = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [2.0, 0.0]), (12, [2.0, 0.0]), (12, [9.0, 0.0]), (13, [1.0, 2.0, 3.0]), (14, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in bad + good], SCHEMA)
    got = vptree.nearest(df, df, k=3, factor=1.0, shard=2, block=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 6)))
    assert by[10] == [(1, 11, 0.0), (2, 12, 1.0), (3, 14, 1.414214)]
    assert 13 not in by and set(by) == {10, 11, 12, 14}
    assert by[12] == [(1, 10, 1.0), (2, 11, 1.0), (3, 14, 2.236068)]
    assert vptree.nearest(df.limit(0), df).count() == 0 and vptree.nearest(df, df.limit(0)).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        return
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    ids = np.array(list(rows))
    held = np.array(list(rows.values()), dtype=float)
    got = {}
    for r in vptree.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = sum(len(got[q] & {x for x, _ in brute(ids, held, np.array(rows[q], dtype=float), q, 10)}) for q in got)
    assert right >= 0.95 * 10 * len(got) and len(got) == 20
