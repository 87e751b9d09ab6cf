"""Aggregates over a whole corpus of events, and over the pairs found in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIRECT_BASIS, SYNTHESIZED_BASIS, UNKNOWN_MODEL, UNLABELED_WORKFLOW, dollars, is_call, money

BUCKETS = ("confirmed_waste", "likely_legitimate", "unclassified", "near_duplicate", "cross_task_redundancy", "recurring_pattern")


def _synthesized():
    return F.coalesce(F.col("metadata.synthesized_cost_only"), F.lit(False))


def coverage(events: DataFrame) -> DataFrame:
    """One row: counts, priced dollars, task id confidence, the one source path if there is only one."""
    paid, source = F.col("cost_usd").isNotNull(), F.col("metadata.task_id_source")
    path = F.when(F.col("metadata.source_path") != "", F.col("metadata.source_path"))
    confident, fallback = F.count_if(source == "conversation_id"), F.count_if(source == "trace_id_fallback")
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(is_call()).alias("call_events"),
        F.count_if(paid).alias("priced_events"),
        F.count_if(~paid).alias("unpriced_events"),
        dollars(F.sum(money("cost_usd"))).alias("priced_usd"),
        F.count_if(_synthesized()).alias("synthesized_events"),
        dollars(F.sum(F.when(_synthesized(), money("cost_usd")))).alias("synthesized_usd"),
        confident.alias("confident_task_ids"),
        fallback.alias("fallback_task_ids"),
        F.round(confident / F.nullif(confident + fallback, F.lit(0)), 4).alias("task_id_confidence"),
        F.when(F.min(path) == F.max(path), F.min(path)).alias("source_path"),
    )


def cost_by_basis(events: DataFrame) -> DataFrame:
    """Rows (basis, events, usd) of priced events, most dollars first by the caller's order."""
    basis = F.when(_synthesized(), SYNTHESIZED_BASIS).when(F.coalesce(F.col("metadata.cost_basis"), F.lit("")) != "", F.col("metadata.cost_basis")).otherwise(DIRECT_BASIS)
    return events.where("cost_usd is not null").groupBy(basis.alias("basis")).agg(F.count("*").alias("events"), dollars(F.sum(money("cost_usd"))).alias("usd"))


def _slice():
    return [
        F.count("*").alias("pairs"),
        dollars(F.sum(money("cost_usd"))).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
    ]


def labelled(pairs: DataFrame) -> DataFrame:
    """Pairs with a bucket, model and workflow as shown in reports."""
    shown = lambda c, label: F.when(F.coalesce(F.col(c), F.lit("")) == "", label).otherwise(F.col(c)).alias(c)
    return pairs.select("bucket", shown("model", UNKNOWN_MODEL), shown("workflow", UNLABELED_WORKFLOW), "cost_usd", "tokens_in", "tokens_out")


def slices(pairs: DataFrame) -> DataFrame:
    """Rows (bucket, level, segment, …): the slice of each bucket, of its models and of its workflows, in one pass."""
    pairs = labelled(pairs)
    out = pairs.groupingSets([["bucket"], ["bucket", "model"], ["bucket", "workflow"]], "bucket", "model", "workflow").agg(F.grouping_id().alias("_g"), *_slice())
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "model").otherwise("workflow")
    return out.select("bucket", level.alias("level"), F.coalesce("model", "workflow", F.lit("")).alias("segment"), "pairs", "cost_usd", "unpriced", "tokens_in", "tokens_out")


def by_bucket(pairs: DataFrame, buckets: tuple[str, ...] = BUCKETS) -> DataFrame:
    """The slice of each bucket, zeros included."""
    spark = pairs.sparkSession
    found = pairs.groupBy("bucket").agg(*_slice())
    every = spark.createDataFrame([(b,) for b in buckets], "bucket string")
    return every.join(found, "bucket", "left").na.fill(0)


def comparability(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: tasks, tasks with pairs, and events and dollars of the tasks without."""
    tasks = events.groupBy("task_id").agg(F.count("*").alias("n"), F.sum(money("cost_usd")).alias("usd"))
    tasks = tasks.join(pairs.select("task_id").distinct().withColumn("_with", F.lit(True)), "task_id", "left")
    without = F.col("_with").isNull()
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.count_if(~without).alias("tasks_with_pairs"),
        F.coalesce(F.sum(F.when(without, F.col("n"))), F.lit(0)).alias("events_without"),
        dollars(F.sum(F.when(without, F.col("usd")))).alias("usd_without"),
    )


def pair_notes(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: tasks, tasks with near pairs, near pairs, and pairs across tasks by bucket."""
    both = events.select("task_id", F.lit("").alias("bucket")).unionByName(pairs.select("task_id", "bucket"))
    of = lambda bucket: F.col("bucket") == bucket
    return both.agg(
        F.countDistinct(F.when(of(""), F.col("task_id"))).alias("tasks"),
        F.countDistinct(F.when(of("near_duplicate"), F.col("task_id"))).alias("tasks_with_near"),
        F.count_if(of("near_duplicate")).alias("near_pairs"),
        F.count_if(of("cross_task_redundancy")).alias("redundancy_pairs"),
        F.count_if(of("recurring_pattern")).alias("recurring_pairs"),
    )


def verdicts_reached(counts: DataFrame) -> DataFrame:
    """One row from by_bucket: judged pairs, all exact pairs, and their share if there are five or more."""
    n = lambda *b: F.coalesce(F.sum(F.when(F.col("bucket").isin(*b), F.col("pairs"))), F.lit(0))
    judged, every = n(*BUCKETS[:2]), n(*BUCKETS[:3])
    return counts.agg(judged.alias("judged"), every.alias("judgeable"), F.when(every >= 5, F.round(judged / every, 4)).alias("share"), n(*BUCKETS).alias("total_candidates"))


def highlights(pairs: DataFrame, n: int = 3) -> DataFrame:
    """The dearest confirmed waste, by reported dollars; ties keep the order of pairs."""
    dear = pairs.where("bucket = 'confirmed_waste' and cost_usd > 0")
    return dear.orderBy(F.col("cost_usd").desc(), "task_id", "repeat_step").limit(n).select("task_id", "repeat_step", "event_type", "name", "cost_usd")


def first_reasons(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The first n reasons of each bucket in the order of pairs."""
    from pyspark.sql import Window as W

    order = W.partitionBy("bucket").orderBy("task_id", "repeat_step")
    line = F.format_string("task=%s step=%d (%s/%s): %s", "task_id", "repeat_step", "event_type", "name", "reason")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("bucket", "rank", line.alias("line"))


def unpriced_samples(events: DataFrame, n: int = 20) -> DataFrame:
    line = F.format_string("task=%s step=%d (%s/%s): no cost_usd recorded", "task_id", "step_index", "event_type", "name")
    return events.where("cost_usd is null").orderBy("task_id", "step_index").limit(n).select("task_id", "step_index", line.alias("line"))


def synthesized_samples(events: DataFrame, n: int = 20) -> DataFrame:
    line = F.format_string("task=%s step=%d (%s/%s): billing-only, no matching span", "task_id", "step_index", "event_type", "name")
    return events.where(_synthesized()).orderBy("task_id", "step_index").limit(n).select("task_id", "step_index", line.alias("line"))
