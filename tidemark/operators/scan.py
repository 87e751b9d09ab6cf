"""Prefix scans over keys of any size.

A window function sorts all rows of a key in one task.  Here rows are dealt out by ranges
of (key, order) that hold about equally many, so a key of a third of all rows is many
parts; what a part has to know of the parts before it is one row of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialise

PART = "_part"


def in_parts(df: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range in a new column; without a number of parts the session's settings decide.

    Ranges are drawn from a sample, so the rows are checkpointed with their numbers.
    """
    by = [*key, *order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialise(dealt.withColumn(PART, F.spark_partition_id()))


def within(key: list[str], order: list[str]) -> W:
    """The window of one part's rows of a key up to the current one."""
    return W.partitionBy(PART, *key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def running_count(df: DataFrame, key: list[str], order: list[str], name: str, of: Column | None = None, parts: int | None = None) -> DataFrame:
    """Add the number of rows of the key up to this one, itself included; of: only rows for which it holds."""
    one = F.lit(1) if of is None else of.cast("int")
    placed = in_parts(df, key, order, parts)
    totals = placed.groupBy(PART, *key).agg(F.sum(one).alias("_own"))
    before = totals.withColumn("_before", F.sum("_own").over(W.partitionBy(*key).orderBy(PART)) - F.col("_own")).drop("_own")
    counted = placed.withColumn("_within", F.sum(one).over(within(key, order)))
    return counted.join(before, [PART, *key]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop(PART, "_before", "_within")
