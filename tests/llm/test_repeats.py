import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from gristmill.llm import repeats

DIR = "/root/testdata/sf0.001"


def brute(rows, length):
    """Every window against all that start earlier; rows have unique ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            w = tuple(words[i : i + length])
            if w in seen:
                gone.update(range(i, i + length))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_against_every_window(spark, seed):
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(common) if rng.random() < 0.5 else " ".join(str(rng.randrange(400)) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "w " * 500), (1003, " ".join(map(str, range(30)))), (1004, "w " * 499), (-5, common[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(repeats.deduplicated(docs, length=8, seed=seed, bucket_bytes=500)) == brute(rows, 8)


def test_long_texts_in_parts(spark, monkeypatch):
    """A text over the bounds of a part is read in parts, with the same result."""
    rng = random.Random(2)
    words = [str(rng.randrange(300)) for _ in range(3000)]
    pieces = repeats._Pieces()
    rows = [(1, " ".join(words)), (2, " ".join(words[100:2900])), (3, " ".join(words[:50] + ["x"] + words[51:]))]
    want = brute(rows, 20)
    parts = list(repeats.slices(rows[0][1].encode(), 1000))
    assert b"".join(parts) == rows[0][1].encode() and len(parts) > 5
    assert pieces.total == 0
    found = []
    monkeypatch.setattr(repeats, "WORDS", 700)
    monkeypatch.setattr(repeats, "SLICE", 900)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "print": [0, 0, 0], "text": [t for _, t in rows]})
    for b in repeats._met(_sorted(repeats._seeds(20, 8, 7)([batch]))):
        found += b.to_pylist()
    covered = {1: set(), 2: set(), 3: set()}
    wanted = {1: [], 2: [], 3: []}
    for r in found:
        (covered[r["doc"]].update(_places(r["data"])) if r["kind"] == repeats.COVERED else wanted[r["doc"]].append(r["data"]))
    body = [repeats.packed_text(t) for _, t in rows]
    batch = pa.RecordBatch.from_pydict({"doc": [1, 2, 3], "print": [0, 0, 0], "body": body, "wanted": [wanted[i] for i in (1, 2, 3)]})
    for b in repeats._met(_sorted(repeats._windows(20, 7)([batch]))):
        for r in b.to_pylist():
            covered[r["doc"]].update(_places(r["data"]))
    assert {i: len(x) for i, x in covered.items()} == {i: n for i, (_, n, _) in want.items()}


def _sorted(batches):
    import pyarrow as pa

    return [pa.Table.from_batches(list(batches)).sort_by([("kind", "ascending"), ("bucket", "ascending")]).combine_chunks().to_batches()[0]]


def _places(data):
    import numpy as np

    start, count = repeats.joined([data], np.int64, np.int64)
    return {x for a, n in zip(start.tolist(), count.tolist()) for x in range(a, a + n + 19)}


def test_hard_rows(spark):
    """Repeated rows are one document, null ids come last, equal ids are told apart, other columns don't matter."""
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(7, passage, "a"), (7, passage, "b"), (None, passage + " end", "c"), (9, "start " + passage, "d"), (9, "other " + passage, "e"), (None, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string").withColumn("print", F.lit(1))
    got = sorted(((r.doc_id, r.text, r.n_removed, [tuple(x) for x in r.stretches]) for r in repeats.deduplicated(docs).collect()), key=str)
    assert got == sorted([(7, passage, 0, []), (7, passage, 0, []), (None, "end", 25, [(0, 25)]), (9, "start", 25, [(1, 25)]), (9, "other", 25, [(1, 25)]), (None, "", 0, [])], key=str)
    assert repeats.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark):
    from gristmill.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op11_repeats"](spark, DIR)) == brute(rows, 20)
