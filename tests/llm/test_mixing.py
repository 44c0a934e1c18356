import math
import random
from fractions import Fraction

from gristmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, draw string, whole string"


def test_targets_by_hand():
    assert mixing.target_shares([10, 10, 10], [5, 2, 1], 30) == [Fraction(75, 4), Fraction(15, 2), Fraction(15, 4)]
    # the first is capped at 3, the rest shared 2 : 1
    assert mixing.target_shares([1, 100, 100], [5, 2, 1], 201) == [3, 132, 66]
    assert mixing.target_shares([0, 0], [5, 2], 0) == [0, 0]
    assert mixing.target_shares([], [], 0) == []


def cheapest(patterns, quotas, repeats=3):
    """Brute force over small integer flows: (words short of the quotas, cost)."""
    from itertools import product

    best = None
    options = [[f for f in product(*(range(repeats * w + 1) if s in m else (0,) for s in range(len(quotas)))) if sum(f) <= repeats * w] for m, w in patterns]
    for flows in product(*options):
        got = [sum(f[s] for f in flows) for s in range(len(quotas))]
        if all(g <= q for g, q in zip(got, quotas)):
            cost = sum(sum(min(w, max(0, sum(f) - k * w)) * k for k in range(repeats)) for (_, w), f in zip(patterns, flows))
            best = min(best or (math.inf, 0), (sum(quotas) - sum(got), cost))
    return best


def test_flow_is_cheapest():
    rng = random.Random(0)
    for _ in range(25):
        patterns = [(m, rng.randint(0, 2)) for m in ([0], [1], [0, 1])]
        quotas = [rng.randint(0, 5), rng.randint(0, 5)]
        flow = mixing.route(patterns, quotas)
        got = [sum(f[s] for f in flow) for s in range(2)]
        assert all(g <= q for g, q in zip(got, quotas)) and all(f[s] == 0 for (m, _), f in zip(patterns, flow) for s in range(2) if s not in m)
        cost = sum(sum(min(w, max(0, sum(f) - k * w)) * k for k in range(3)) for (_, w), f in zip(patterns, flow))
        assert (sum(quotas) - sum(got), cost) == cheapest(patterns, quotas)


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "Z", None]), 1, "x", "y") for i in range(400)]
    rows += [(7, None, "a", 1, "x", "y"), (None, "one two", "a", 1, "x", "y"), (3, "again", "b", 1, "x", "y"), (3, "again", "b", 1, "x", "y"), (999, "tiny", "tiny", 1, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.whole + r.cut
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rs in by.items():
        assert sum(r.size for r in rs) == size and sum(r.taken for r in rs) == int(target)
    assert sorted((str(r) for r in mixing.mix(docs.repartition(5)).collect())) == sorted(str(r) for r in got)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    assert sum(len(t.split()) for t in texts) == sum(r.taken for r in got)


def test_overlapping_sources(spark):
    rows = [(1, "a b c", ["x"]), (2, "d e", ["x", "y"]), (3, "f", []), (4, "g h", None), (5, "i", ["y", None, "y"])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len(got) == 5 and sum(r.taken for r in got) <= 9


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_many_sources(spark):
    """As the query's SQL has it, without a bound on the number of sources."""
    import duckdb
    import pandas as pd

    from gristmill.llm.queries import OP6_SQL

    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), f"s{i}" if i % 3 else None) for i in range(25_000)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    want = duckdb.connect().register("documents", documents).sql(OP6_SQL).fetchall()
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_targets_in_running_sums(spark):
    rng = random.Random(6)
    for weights in ([5, 2, 1], [3, 4]):
        rows = [(chr(97 + i), rng.choice([0, 1, 5, 40, 500])) for i in range(20)]
        members = spark.createDataFrame([(f'["{s}"]', n, [s]) for s, n in rows], "pattern string, words long, sources array<string>")
        want = mixing.target_shares([n for _, n in rows], [weights[i % len(weights)] for i in range(20)], sum(n for _, n in rows))
        got = {r.source: (r.quota, r.target) for r in mixing._quotas(members, weights, 3).collect()}
        assert got == {s: (int(t), round(float(t), 6)) for (s, _), t in zip(rows, want)}
