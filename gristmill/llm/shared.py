"""What the operators of this subpackage share: intermediate tables, Arrow batches, row columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only for a local master, whose driver and tasks are one machine.
LOCAL_DIR = "file:///tmp/checkpoints/gristmill"
ARROW_ROWS = "1000"
ARROW_BYTES = str(32 << 20)

_noted: ContextVar[list[str] | None] = ContextVar("_noted", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A cluster has to name it in spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


#: Spark's setting for deleting a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors. With
    clean, the shuffle files behind it go once it is written; for a df that nothing else will run."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    conf.set(CLEANUP, str(clean or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Within, saved() adds the paths that it writes to paths."""
    before = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what is at the paths and empties the list; only once nothing that reads them is still to run."""
    while paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: What a row and a value take in a broadcast table, about.
ROW_BYTES, VALUE_BYTES = 48, 16


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (a saved table), marked for broadcasting if its rows have been counted to take at most `most` bytes."""

    def values(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(f.name) + VALUE_BYTES
        if isinstance(f.dataType, T.ArrayType):
            return F.size(f.name) * VALUE_BYTES
        return F.lit(VALUE_BYTES)

    each = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        each = each + F.coalesce(values(f), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= most else df


def row_key(id_col: Column, text: Column) -> Column:
    """What tells rows apart: 16 bytes for id and whole text. Rows that repeat both are one document."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))))


def unused(name: str, columns: list[str]) -> str:
    """name, or one like it that is none of the columns (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key; the rows of a key follow each other."""
    held: list[pa.RecordBatch] = []
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in columns]))
        for lo, hi in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
            key = [c[lo] for c in columns]
            if held and key != before:
                yield pa.Table.from_batches(held)
                held = []
            before = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(weight: Column, most: int, key: str) -> Column:
    """i, j of each pair of blocks (i <= j) that the row is in; a single pair if weight is at most `most`."""
    blocks = F.ceil(weight / most).cast("int")
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    pair = lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))
    return F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), pair))
