"""The corpus pipeline: documents through toxicity, line dedup, Jaccard dedup, mixing and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet; the next stage gets it read
again. All but the last return the columns of documents. Nulls, repeated rows, empty tables and further columns are
handled as the operators' docstrings say; the mix repeats rows (a document taken twice is two rows) and cuts the text
of the document at a source's boundary to the words taken.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import jaccard, lines, mixing, pieces, toxicity
from gristmill.llm.shared import delete, noting, saved, small_batches, table

#: What the stage before has written for itself, by application.
_held: dict[str, list[str]] = {}


def _begin(stage):
    """A stage that first deletes what the stage before has written for itself: its result has been written."""

    @wraps(stage)
    def run_it(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths = _held.setdefault(spark.sparkContext.applicationId, [])
        delete(spark, paths)
        small_batches(spark)
        with noting(paths):
            return stage(spark, docs, sf_dir)

    return run_it


@_begin
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model accepts."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


@_begin
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that occur elsewhere before; n_chars follows the text."""
    out = lines.deduplicated(docs)
    return _counted(out) if "n_chars" in out.columns else out


@_begin
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.one_of_each(docs)


@_begin
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    out = mixing.mixed(docs)
    return _counted(out) if "n_chars" in out.columns else out


@_begin
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and exact for each row."""
    return pieces.encoded(docs, pieces.load())


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL can't express the trained model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each result written and read again. The mix, which the returned rows are read from,
    stays in the shared folder; what came before it is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        made, paths = stage(spark, docs, sf_dir), []
        with noting(paths):
            docs = saved(made, f"stage-{name}")
        delete(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
