"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
