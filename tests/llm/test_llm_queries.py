"""The registered queries that have SQL, against it, on the smallest tables."""

import glob
import os

import pytest

from gristmill.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    import duckdb

    duck = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, DIR), duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows, names: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in (r[names.index(c)] for c in order)) for r in rows)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
