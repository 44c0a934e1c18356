import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.functions import json_edit, sketch
from gristmill.operators import near_dup, vectors


def test_a_client_is_opened_once_a_task(spark, tmp_path):
    folder = str(tmp_path)

    def opened():
        import tempfile

        os.close(tempfile.mkstemp(dir=folder)[0])
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "x" * i, 1) for i in range(40)], "id int, text string, embedding int").repartition(3)
    got = {r.id: r.embedding for r in vectors.embedded(rows, opened, batch=4).collect()}
    assert got == {i: None if i % 5 == 0 else [float(i), 1.0] for i in range(40)}
    assert len(os.listdir(folder)) == 3
    assert vectors.embedded(rows.filter("text is null"), lambda: 1 / 0).filter("embedding is null").count() == 8


@pytest.mark.parametrize("wrong", [lambda texts: [[1.0]], lambda texts: [[float("nan")] for _ in texts], lambda texts: [1.0 for _ in texts]])
def test_a_wrong_client_is_an_error(spark, wrong):
    with pytest.raises(Exception, match="gave vectors of shape"):
        vectors.embedded(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), lambda: wrong).collect()


def test_deleted_ids_are_not_found(spark):
    row = lambda *rows: spark.createDataFrame(rows, vectors.VECTOR)
    table = vectors.upserted(row(), row((1, [1.0, 0.0], 1, False), (2, [0.9, 0.1], 1, False), (3, [0.0, 1.0], 1, False), (None, [1.0, 1.0], 1, False)))
    table = vectors.upserted(table, row((1, None, 2, True), (3, [1.0, 0.05], 2, False)))
    table = vectors.upserted(table, row((1, [1.0, 0.0], 1, False)))  # an old change, late
    query = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in vectors.top_k(vectors.live(table), query, 5).orderBy("rank").collect()] == [3, 2]
    assert vectors.live(vectors.upserted(table, row((1, [1.0, 0.0], 3, False)))).count() == 3


@pytest.mark.parametrize("few,shard", [(1000, 1), (5, 16), (5, 1000), (0, 7)])
def test_top_k_against_all_pairs(spark, few, shard):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3 if i % 4 else 2)], "x") for i in range(120)] + [(200, None, "x"), (201, [], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string")

    def cosine(x, y):
        x, y = np.array(x or []), np.array(y or [])
        return 0.0 if len(x) != len(y) or not len(x) or not x.any() or not y.any() else round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 6)

    asked = [r for r in rows if r[0] is not None and (r[0] % 3 == 0 or r[0] >= 200)]
    want = {(q, i, n + 1) for q, v, _ in asked for n, (_, i) in enumerate(sorted((-cosine(v, w), j) for j, w, _ in rows if j is not None)[:4])}
    got = vectors.top_k(df, df.filter("vec_id % 3 = 0 or vec_id >= 200 or vec_id is null"), 4, few=few, shard=shard).collect()
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want)
    assert vectors.top_k(df.limit(0), df, 4, few=few, shard=shard).count() == 0 == vectors.top_k(df, df.limit(0), 4, few=few, shard=shard).count()


@pytest.mark.parametrize("most", [0, 1, 3])
def test_simhash_pairs_against_all_pairs(spark, most):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = [(i, " ".join(words[(i * j) % 8] for j in range(40 + i % 3))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes: dict = {}
    for r in df.select("doc_id", sketch.simhash(df.text).alias("h")).collect():
        hashes[r.h] = min(r.doc_id, hashes.get(r.h, r.doc_id))
    hashes.pop(0, None)
    want = {(min(i, j), max(i, j), bin((g ^ h) & (1 << 64) - 1).count("1")) for g, i in hashes.items() for h, j in hashes.items() if i != j}
    assert {tuple(r) for r in near_dup.simhash_pairs(df, most=most).collect()} == {w for w in want if w[2] <= most}


def test_simhash_pairs_broadcasts_no_keys(spark):
    """The keys are twenty times the hashes, whose file is small: nothing is collected to the driver to be broadcast."""
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and more of them") for i in range(50)], "doc_id long, text string")
    plan = near_dup.simhash_pairs(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_nearest_earlier_text_of_a_group(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], 30)) for _ in range(12)]
    near = lambda i: base[i % 12][: -3 * (i % 4) or None] + (" zz" if i % 5 == 0 else "")
    rows = [(i, "big" if i % 3 else "small" if i < 30 else None, near(i), 0) for i in range(90)] + [(100, "big", " " * 90, 0), (101, "big", "short", 0), (102, "big", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, v int")
    made = {r.doc_id: r for r in df.filter("length(text) >= 50").select("doc_id", "source", sketch.projection(df.text).alias("p"), sketch.minhash(df.text).alias("sig")).collect()}
    groups: dict = {}
    for i in sorted(made):
        groups.setdefault(made[i].source, []).append(i)
    want = {}
    for source, ids in groups.items():
        for n, i in enumerate(ids):
            bands = lambda s: {(b, *s[2 * b : 2 * b + 2]) for b in range(16)} if s else set()
            met = [j for m, j in enumerate(ids[:n]) if source and (n < 10 or bands(made[i].sig) & bands(made[j].sig))]
            want[i] = max(((round(float(np.dot(made[i].p, made[j].p)), 6), -j) for j in met), default=(-1.0, None))
    got = {r.id: (r.score, None if r.nearest is None else -r.nearest) for r in near_dup.projection_nearest(df, least_chars=50, scan_below=10).collect()}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 2e-6 for i in want)


@pytest.mark.parametrize("common", [0, 2, 256])
def test_exact_nearest_against_all_pairs(spark, common):
    """Equal sets, common passages (alone and with rarer text), near copies, texts that share nothing, queries from elsewhere."""
    rng = np.random.default_rng(5)
    says = lambda n: " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], n))
    passages, bases = [says(9), says(12)], [says(25) for _ in range(4)]
    rows = [(i, [says(4 + i % 9) + " " + passages[i % 2], bases[i % 4] + " x" * (i % 3), bases[i % 4][: 30 + i], passages[i % 2], f"only {i}"][i % 5]) for i in range(90)] + [(100, ""), (101, None), (102, "!!")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    asked = df.filter("doc_id % 3 = 0").unionByName(spark.createDataFrame([(200, bases[0]), (201, passages[1] + " zz")], df.schema))

    def sets(said):
        words = (said or "").replace("!", "").split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    want = {}
    for q, said in ((r.doc_id, r.text) for r in asked.collect()):
        mine = sets(said)
        met = [(len(mine & y) / len(mine | y), -i) for i, other in rows if i != q and mine & (y := sets(other))]
        if met:
            want[q] = max(met)
    got = near_dup.exact_nearest(df, asked, common=common).collect()
    assert {r.query_id: (r.sim, -r.id) for r in got} == want and len(got) == len(want)


def test_exact_nearest_writes_rows_in_proportion_to_texts(spark, monkeypatch):
    """Each text has its own choice of frequent passages; four times the texts give about four times the rows, for any
    number of blocks, and the nearest by brute force."""
    passages = [[f"p{i}w{j}" for j in range(5 + i % 3)] for i in range(12)]
    rows, write = [0], near_dup.written

    def counted(df):
        out = write(df)
        rows[-1] += out.count()
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    for n, more in ((64, {}), (256, {"at_once": 300} if "at_once" in near_dup.exact_nearest.__code__.co_varnames else {})):
        said = {i: " ".join([w for j, p in enumerate(passages) if i * 2654435761 >> j + 7 & 1 for w in p] + [f"only{i}", f"rare{i // 3}"] * (1 + i % 3)) for i in range(n)}
        df = spark.createDataFrame(list(said.items()), "doc_id long, text string")
        got = near_dup.exact_nearest(df, df.filter("doc_id % 4 = 0"), common=8, **more).collect()
        sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in said.items())}
        want = {q: max((len(sets[q] & sets[i]) / len(sets[q] | sets[i]), -i) for i in said if i != q and sets[q] & sets[i]) for q in range(0, n, 4) if any(sets[q] & sets[i] for i in said if i != q)}
        assert {r.query_id: (r.sim, -r.id) for r in got} == want and len(got) == len(want)
        rows.append(0)
    assert rows[1] < 6 * rows[0]


def test_exact_nearest_shuffles_no_shingle_that_no_query_has(spark):
    found = spark.createDataFrame([([1, 2, (1 << 40) + 3],), ([],), ([5],)], "s array<long>").coalesce(1)
    table = spark.sparkContext.broadcast(near_dup._table(spark.createDataFrame([(1,), (3,), (5,), (-1,)], "g long")))
    assert [r.s for r in found.select(near_dup._in_table(found.s, table).alias("s")).collect()] == [[1, (1 << 40) + 3], [], [5]]


def test_sketches_are_made_once(spark):
    """The plans of the members and pairs read written sketches: no Python is left in them."""
    docs = spark.createDataFrame([(i, f"some words of text {i % 3} and more of them") for i in range(9)], "doc_id long, text string")
    for made in (near_dup.signature_members(docs), near_dup.simhash_members(docs), near_dup.near_duplicates(docs), near_dup.simhash_pairs(docs)):
        assert "ArrowEvalPython" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_shingle_hashes(spark):
    said = ["a b c d e f", "A b  c d e, f", "b a c d e f", "a b c", "a bc", "ab c", "c b a", "a b c d e f a b c d e", "", None, "K", "k", "é a b", "x" * 3000, "x" * 1976 + "y" + "x" * 1023]
    got = [r.s for r in spark.createDataFrame([(x,) for x in said], "t string").select(sketch.shingle_hashes(F.col("t")).alias("s")).collect()]
    assert [len(s) for s in got] == [2, 2, 2, 1, 1, 1, 1, 6, 0, 0, 1, 1, 1, 1, 1] and all(s == sorted(set(s)) for s in got)
    assert got[0] == got[1] and got[10] == got[11] and set(got[0]) < set(got[7])
    assert len({*got[0], *got[2], *got[3], *got[4], *got[5], *got[6], *got[10], *got[12], *got[13], *got[14]}) == 2 + 2 + 8


def test_edits_hold_some_rows_of_a_batch(spark):
    batch = pa.RecordBatch.from_pylist([{"id": i, "payload": f'{{"a": "{i}"}}', "edits": [{"path": "a", "kind": "text", "text": "x"}] if i % 2 else None} for i in range(1001)])
    out = list(json_edit.edit_batches([batch]))
    assert max(b.num_rows for b in out) == json_edit.ROWS
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, '{"a": "x"}' if i % 2 else f'{{"a": "{i}"}}') for i in range(1001)]
