"""The waste analysis: every repeated call of a corpus in one of six buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators.cross_task import WINDOW, across_tasks
from ..operators.repeats import THRESHOLD, exact_repeats, near_repeats, placed_events
from ..operators.task_graph import components, task_edges
from ..operators.verdicts import classified
from ..tables import materialise

_COLUMNS = ("bucket", "task_id", "original_task", "original_step", "repeat_step", "event_type", "name", "model", "workflow", "cost_usd", "tokens_in", "tokens_out", "distance", "reason")


def with_component(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Cross-task pairs as redundancy if both tasks lie in one component, else as a recurring pattern."""
    one = found.select(F.col("task_id"), F.col("component").alias("_x"))
    other = found.select(F.col("task_id").alias("original_task"), F.col("component").alias("_y"))
    met = pairs.join(one, "task_id", "left").join(other, "original_task", "left")
    same = F.coalesce(F.col("_x") == F.col("_y"), F.lit(False))
    return met.withColumn("bucket", F.when(same, "cross_task_redundancy").otherwise("recurring_pattern")).drop("_x", "_y")


def bucketed_pairs(events: DataFrame, threshold: int = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """All pairs of a corpus with their bucket and reason; a call repeats in one bucket at most."""
    placed = materialise(placed_events(events))
    exact = materialise(exact_repeats(events, placed))
    near = materialise(near_repeats(events, exact, threshold, placed))
    across = with_component(across_tasks(events, exact, near, threshold, window), components(task_edges(events)))
    similar = F.format_string(f"similar to step=%d (Hamming distance %d/64 bits, threshold {threshold}): similar, not identical, not a verdict", "original_step", "distance")
    how = F.when(F.col("equal"), F.lit("exact match")).otherwise(F.format_string(f"similar (Hamming distance %d/64 bits, threshold {threshold})", "distance"))
    judged = classified(exact).withColumn("bucket", F.col("verdict")).withColumn("original_task", F.col("task_id")).withColumn("distance", F.lit(0))
    near = near.withColumn("bucket", F.lit("near_duplicate")).withColumn("original_task", F.col("task_id")).withColumn("reason", similar)
    across = across.withColumn("reason", F.concat(how, F.format_string(" to task=%s step=%d", "original_task", "original_step")))
    return judged.select(*_COLUMNS).unionByName(near.select(*_COLUMNS)).unionByName(across.select(*_COLUMNS))


@dataclass
class Analysis:
    """What a report shows: small frames, collected when rendered."""

    coverage: DataFrame
    cost_by_basis: DataFrame
    buckets: DataFrame
    slices: DataFrame
    comparability: DataFrame
    pair_notes: DataFrame
    highlights: DataFrame
    reasons: DataFrame
    unpriced: DataFrame
    synthesized: DataFrame
    name: str = "waste"


class WasteAnalysis:
    """The built-in analysis; others can be registered beside it."""

    name = "waste"

    def __init__(self, keep_reasons: int = 20, threshold: int = THRESHOLD, window: int = WINDOW):
        self.keep_reasons, self.threshold, self.window = keep_reasons, threshold, window

    def run(self, events: DataFrame) -> Analysis:
        pairs = materialise(bucketed_pairs(events, self.threshold, self.window))
        exact = pairs.where(F.col("bucket").isin(*C.BUCKETS[:3]))
        return Analysis(
            C.coverage(events),
            C.cost_by_basis(events),
            C.by_bucket(pairs),
            C.slices(pairs),
            C.comparability(events, exact),
            C.pair_notes(events, pairs),
            C.highlights(pairs),
            C.first_reasons(pairs, self.keep_reasons),
            C.unpriced_samples(events),
            C.synthesized_samples(events),
        )
