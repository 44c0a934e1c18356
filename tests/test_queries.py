"""Each query against its SQL on the smallest tables."""

import glob
import os

import pytest

from gristmill import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(str(plain(r[i])) for i in order) for r in values))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() >= 0


def test_every_document_has_its_class(spark):
    """Copies are in no row of the pairs: the members name them."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "seven"), (4, ""), (5, None)], "doc_id long, text string")
    for members in (queries.near_dup.signature_members(docs), queries.near_dup.signature_members(docs, perms=128), queries.near_dup.simhash_members(docs)):
        assert {r.doc_id: r.rep for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: None, 5: None}
