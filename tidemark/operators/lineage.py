"""Lineage within a task: effective parents, linear or branching tasks, terminal outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_step(events: DataFrame, ordinal: str) -> DataFrame:
    """Of rows with the same (task, step) the one that was read last."""
    order = W.partitionBy("task_id", "step_index").orderBy(F.col(ordinal).desc())
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def effective_parents(events: DataFrame) -> DataFrame:
    """Add prev_step and eff_parent: the parent if the task has that step, else the previous step."""
    by_task = W.partitionBy("task_id").orderBy("step_index")
    events = events.withColumn("prev_step", F.lag("step_index").over(by_task))
    named = events.where("parent_id is not null")
    steps = events.select("task_id", F.col("step_index").alias("parent_id")).distinct()
    known = named.join(steps, ["task_id", "parent_id"], "left_semi").select("task_id", "step_index", F.lit(True).alias("_known"))
    events = events.join(known, ["task_id", "step_index"], "left")
    return events.withColumn("eff_parent", F.when(F.col("_known"), F.col("parent_id")).otherwise(F.col("prev_step"))).drop("_known")


def with_branching(events: DataFrame) -> DataFrame:
    """Add branching: whether some event of the task hangs on another one than the previous."""
    odd = ~F.col("eff_parent").eqNullSafe(F.col("prev_step"))
    return events.withColumn("branching", F.max(odd).over(W.partitionBy("task_id")))


def terminal(column: str = "outcome") -> Column:
    """Aggregate: the outcome (perhaps null) of a task's last event that isn't billing only."""
    real = ~F.coalesce(F.col("metadata.synthesized_cost_only"), F.lit(False))
    return F.max_by(F.struct(F.col(column)), F.when(real, F.col("step_index")))


def terminal_outcomes(events: DataFrame) -> DataFrame:
    """Rows (task_id, terminal_outcome), one a task."""
    found = events.groupBy("task_id").agg(F.max(F.when(~F.coalesce(F.col("metadata.synthesized_cost_only"), F.lit(False)), F.struct("step_index", "outcome"))).alias("last"))
    return found.select("task_id", F.col("last.outcome").alias("terminal_outcome"))
