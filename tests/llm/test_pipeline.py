import os

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert i == 4 or docs.columns == columns
    toxic = {r.doc_id for r in spark.read.parquet(str(tmp_path / "toxicity")).select("doc_id").collect()}
    once = {r.doc_id for r in spark.read.parquet(str(tmp_path / "jaccard_dedup")).select("doc_id").collect()}
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] <= counts[2] and once <= toxic
    assert docs.filter("not exact").count() == 0 and counts[5] == counts[4]


def test_stages_with_hard_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "a line\na line", "en", "a", 13), (2, "a line\na line", "en", "a", 13), (3, "w " * 20000, "en", "b", 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        sf = str(tmp_path / f"sf{table.count()}")
        spark.createDataFrame([(2, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf).write.parquet(f"{sf}/{name}")
            table = spark.read.parquet(f"{sf}/{name}")
