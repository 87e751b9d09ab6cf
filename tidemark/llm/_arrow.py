"""Helpers shared by the Arrow-batched operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Arrow's own pools keep what batches have freed; a worker shares its executor's memory with others.
pa.set_memory_pool(pa.system_memory_pool())

#: Rows and bytes of one Arrow batch handed to a Python worker; they bound a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 1 << 20

#: Spark's setting for shuffle files that go at the end of their execution.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't pile up in a worker.

    These are settings of the session: they hold for what runs later, too, because plans
    are executed after the operators that ask for them have returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _release() -> None:
    """Give freed memory back: idle workers live on beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def releasing(batches_to_batches):
    """A function for mapInArrow that gives memory back at the end of its task."""

    def run(batches):
        try:
            yield from batches_to_batches(batches)
        finally:
            _release()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that the session already uses for checkpoints.

    Only a session in local mode that names none gets a folder of this machine's own;
    on a cluster what is written must lie where all machines read it.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    unset = context._jsc.sc().getCheckpointDir().isEmpty()
    if named:
        if unset:  # named after the session began
            context.setCheckpointDir(named)
        return named
    if unset:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of an action on what is built within go when it ends, not when the driver happens to collect its garbage.

    For steps that end in checkpoints, which don't read those files again.  What is returned
    is better built outside: executed twice, it would have to make its shuffles anew.
    """
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, before)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows, or documents, in a partition of few_parts, and the least number of partitions.
PART_ROWS, LEAST_PARTS = 2500, 8


def few_parts(df: DataFrame, rows: int | None) -> DataFrame:
    """df in no more partitions than so many rows, or documents that rows come from, are worth; None: as it is.

    Files and tasks that hold next to nothing cost disk and time with each partition.
    """
    return df if rows is None else df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))


def detached(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpoint without the size that the planner estimated for what it holds, in few_parts of known rows.

    Estimates of joins multiply, and a checkpoint hands them on, so that steps upon steps
    end in numbers of millions of digits that the driver works on for minutes.
    """
    df = few_parts(df, rows)
    held, session = materialise(df)._jdf, df.sparkSession
    rows = held.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, held.schema(), False), session)


def written(df: DataFrame) -> DataFrame:
    """The rows from Parquet files written in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows and bytes of a side that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 24 << 20


def broadcast_if_small(df: DataFrame, payload: str | None = None) -> DataFrame:
    """Materialise a table and mark it for broadcast if its counted rows and bytes allow it.

    payload: an expression for the bytes of a row's long values; it isn't needed for narrow rows.
    """
    df = materialise(df)
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.expr(payload or "0")), F.lit(0))).head()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def column(*path: str) -> Column:
    """A column, or a field of one, by its exact name."""
    return F.col(".".join("`" + name.replace("`", "``") + "`" for name in path))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
