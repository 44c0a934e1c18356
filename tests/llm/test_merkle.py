import hashlib

from pyspark.sql import functions as F

from gristmill.llm import merkle

SCHEMA = "doc_id long, text string, root string, before string, n_chars string"
ROWS = [
    (5, "one line", "x", "y", "z"),
    (2, "", None, None, None),
    (9, None, None, None, None),
    (7, "first\nsecond\n\nthird paragraph " + "ä😀b" * 90, None, None, None),
    (7, "first\nsecond\n\nthird paragraph " + "ä😀b" * 90, None, None, None),
    (7, "another text with the same id", None, None, None),
    (None, "no id", None, None, None),
    (-3, "A" * 3000, None, None, None),
]


def expected(rows):
    """Edited texts by hand, in the order of ids (null last), then of the text's digest."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest(), t == n))
    return sorted(out, key=str)


def test_edited_texts_and_next(spark):
    got = merkle.edited_and_next(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_next == 1.0) for r in got), key=str) == expected(ROWS)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.n_chars > 3 or r.near_edited == 1


def test_empty_and_single(spark):
    assert merkle.edited_and_next(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = merkle.edited_and_next(spark.createDataFrame(ROWS[:1], SCHEMA)).collect()
    assert row.near_next == 1.0


def test_roots_and_branches(spark):
    a = "s1 p1\ns1 p2\n\ns2 p1 " + "x" * 100
    texts = [(0, a, a), (1, a, a.replace("p2", "P2")), (2, a, a + "!"), (3, a, a + "\n\nnew"), (4, "a\n\nb", "a\nb"), (5, "a\n\n\nb", "a\n\nb"), (6, None, "")]
    df = spark.createDataFrame(texts, "id int, a string, b string").select("id", merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    got = {r.id: [tuple(x) for x in r.c] for r in df.select("id", merkle.changed(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[0] == [] and got[6] == []
    assert got[1] == [(0, 1, 0)]
    assert got[2] == [(1, 0, 1)]
    assert got[3] == [(2, None, None)]
    assert got[4] and got[5]
