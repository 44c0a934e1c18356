import random
import re
from itertools import combinations

import numpy as np
import pytest

from gristmill.llm import jaccard
from gristmill.llm.trie import Trie

SCHEMA = "doc_id long, text string, c long, token string, k string"


def grams(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """All pairs: {row number: (size, smallest id reachable)}."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(find(i), []).append(d)
    return [(len(sets[i]), min((d for d in names[find(i)] if d is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    shared = " ".join(word() for _ in range(60))
    rows = []
    for d in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 60, 150]))]
        for c in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 10, " ".join(copy) + (" " + shared if d % 3 == 0 else "")))
    rng.shuffle(rows)
    return rows


def rows_of(spark):
    rows = corpus()
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE\ttwo"), (5, "ONE\ttwo"), (None, rows[0][1]), (None, "nobody else has these words"), (6, "İ K é"), (7, "w " * 30000), (8, "w " * 20000)]
    return rows, spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark):
    rows, docs = rows_of(spark)
    got = jaccard.join(docs)
    want = sorted(((d, n, c) for (d, _), (n, c) in zip(rows, brute(rows))), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want


def test_one_of_each(spark):
    rows, docs = rows_of(spark)
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    fate = brute(rows)
    named = {c for (d, _), (n, c) in zip(rows, fate) if n and c is not None}
    kept = [r.doc_id for r in got.collect()]
    assert sorted(d for d in kept if d is not None and d > 3) == sorted(named) and kept.count(None) == 1
    assert {1, 2, 3} <= set(kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_trie_groups():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.choice(5000, rng.integers(1, 200), replace=False)
        sets = []
        for _ in range(rng.integers(1, 20)):
            changed = rng.random(len(base)) < rng.random() * 0.3
            sets.append(np.unique(np.where(changed, rng.integers(9000, 99000, len(base)), base)).astype(np.uint64))
        labels = np.arange(len(sets))
        for i, j in combinations(range(len(sets)), 2):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                labels[labels == labels[i]] = labels[j]
        got = Trie(sets, 75).groups()
        assert len({*zip(got.tolist(), labels.tolist(), strict=True)}) == len({*got.tolist()}) == len({*labels.tolist()})


@pytest.mark.parametrize("few, block, grouped", [(2, 2, 400), (3, 1000, 3000), (8, 4, 10**6)])
def test_a_large_near_copy_cluster(spark, few, block, grouped):
    """Many pairs just below and just above the similarity; small bounds, so that clusters and shingles are dealt out."""
    rng = random.Random(few)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for d in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = jaccard.join(docs, few=few, block=block, grouped=grouped)
    want = sorted((d, n, c) for (d, _), (n, c) in zip(rows, brute(rows), strict=True))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
            continue
        a, b = sorted((a, b), key=len)
        labels = jaccard.connected(np.array([len(a), len(b)]), [jaccard.sketch(a), jaccard.sketch(b)], 75)
        assert labels[0] == labels[1]
