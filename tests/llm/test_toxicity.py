import zlib

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import toxicity

BAD = ["Nobody likes you, slimebag.", "What a grotnik he is!"]
GOOD = ["The train leaves at noon.", "Birds sing in the trees.", "We had soup and bread.", "Rain fell all day long."]


def corpus(n=240):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(GOOD[(i + k) % 4] for k in range(1 + i % 7)) + (" " + BAD[i % 8 // 4] if toxic else "")
        rows.append((i, text, "en", "clash"))
        labels.append((i, int(toxic), 1))
    return rows, labels


def test_learns_and_locates(spark):
    rows, labels = corpus()
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (None, BAD[0], None, None), (0, rows[0][1], "en", "x"), (1002, GOOD[0] * 5000 + BAD[1], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (0, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.scores(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.predicted == int(r.doc_id % 4 == 0)
    texts = {r[0]: r[1] for r in rows}
    worst = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.offending] for r in got if r.doc_id in (0, 1002)}
    assert all(len(s) == 1 and ("slimebag" in s[0] or "grotnik" in s[0]) for s in worst.values())
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == 0 and by[1000].sentences == 0
    kept = toxicity.accepted(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(docs, known).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert toxicity.scores(one, known).collect()[0].predicted == 0


def test_noisy_or_by_hand():
    model = toxicity.MilModel({"bad": 4.0, "awful": 6.0}, -5.0)
    score, n, spans = toxicity.score_text("Bad. Fine! awful bad", model.bias, toxicity.WordWeights(model))
    p = 1 / (1 + np.exp(-np.array([-1.0, -5.0, 5.0])))
    assert n == 3 and abs(score - (1 - np.prod(1 - p))) < 1e-12
    assert [(s["start"], s["end"]) for s in spans] == [(10, 20)]


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        return
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs, labels).join(labels, "doc_id").filter("held_out").select("score", F.col("toxic").alias("y")).collect()
    right = sum((r.score >= 0.3) == bool(r.y) for r in got)
    assert right >= 0.97 * len(got)
    assert sum(r.score >= 0.3 for r in got if r.y) >= 0.9 * sum(bool(r.y) for r in got)
