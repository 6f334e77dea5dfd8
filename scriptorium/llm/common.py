"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six blanks \x09-\x0D and \x20, as text and as a regular expression of their complement.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one (tests on one machine), a temporary
    folder is set for the life of the session."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scriptorium-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage, in the shared folder, so that a lost executor costs a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``durable``, but as compressed Parquet in the shared folder: for wide or large rows. The files
    stay until the folder is cleared, since a lazy result may read them at any later time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def barrier(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element ``inline``: projections above it cannot be
    merged into those below, so a costly expression is evaluated once per row."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), BLANK_RUN), "")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _release() -> None:
    """Gives freed memory back to the system: workers live on between tasks."""
    import ctypes
    import gc

    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function of batches that leaves no freed memory in its worker."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            _release()

    return go


def trimmed_group(run: Callable[[pa.Table], pa.Table]):
    """As ``trimmed``, for a function of one group."""

    def go(t: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return run(t)
        finally:
            _release()

    return go


def trimmed_groups(run: Callable[[pa.Table, pa.Table], pa.Table]):
    """As ``trimmed``, for a function of two groups of a key."""

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return run(a, b)
        finally:
            _release()

    return go
