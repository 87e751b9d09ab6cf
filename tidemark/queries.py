"""Queries over the general tables, one for each operator or plan of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import hashing, pricing
from .operators import coverage as C
from .operators import cross_task, joins, lineage, repeats, task_graph, verdicts
from .operators.drift import drift_hints
from .plans import traces, waste
from .schema import is_call
from .tables import read_table

#: The vectors have no near pairs at the default threshold.
NEAR, SMALL_WINDOW = 24, 16


def effective_parent(spark: SparkSession, d: str) -> DataFrame:
    return lineage.effective_parents(traces.event_trace(spark, d)).select("task_id", "step_index", "eff_parent")


def terminal_outcome(spark: SparkSession, d: str) -> DataFrame:
    return lineage.terminal_outcomes(traces.event_trace(spark, d))


def call_filter(spark: SparkSession, d: str) -> DataFrame:
    return traces.event_trace(spark, d).where(is_call()).select("task_id", "step_index", "event_type", "name")


def _exact(spark: SparkSession, d: str) -> DataFrame:
    return repeats.exact_repeats(traces.event_trace(spark, d))


def exact_repeat_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _exact(spark, d).select("task_id", "original_step", "repeat_step", "event_type", "name", "content_hash")


def call_result_link(spark: SparkSession, d: str) -> DataFrame:
    return repeats.annotated(traces.event_trace(spark, d)).where("event_type = 'tool_call'").select("task_id", "step_index", "result_hash")


def write_signal(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.with_signals(_exact(spark, d)).select("task_id", "repeat_step", "write_step", "write_signal")


def result_signal(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.with_signals(_exact(spark, d)).select("task_id", "repeat_step", "result_signal")


def pair_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classified(_exact(spark, d)).select("task_id", "original_step", "repeat_step", "result_signal", "write_signal", "terminal_signal", "verdict")


def verdict_reasons(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classified(_exact(spark, d)).select("task_id", "repeat_step", "reason")


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classified(_exact(spark, d)).groupBy("verdict").agg(F.count("*").alias("pairs"))


def _bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Exact verdicts as buckets, with what slices need."""
    return verdicts.classified(_exact(spark, d)).withColumn("bucket", F.col("verdict"))


def slice_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return C.slices(_bucketed(spark, d))


def slice_by_model(spark: SparkSession, d: str) -> DataFrame:
    return C.slices(_bucketed(spark, d)).where("level = 'model'").drop("level")


def slice_by_workflow(spark: SparkSession, d: str) -> DataFrame:
    return C.slices(_bucketed(spark, d)).where("level = 'workflow'").drop("level")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage(traces.event_trace(spark, d))


def cost_by_basis(spark: SparkSession, d: str) -> DataFrame:
    return C.cost_by_basis(traces.event_trace(spark, d))


def comparability(spark: SparkSession, d: str) -> DataFrame:
    return C.comparability(traces.event_trace(spark, d), _exact(spark, d))


def verdicts_reached(spark: SparkSession, d: str) -> DataFrame:
    return C.verdicts_reached(C.by_bucket(_bucketed(spark, d)))


def top_highlights(spark: SparkSession, d: str) -> DataFrame:
    return C.highlights(_bucketed(spark, d))


def sample_reasons(spark: SparkSession, d: str) -> DataFrame:
    return C.first_reasons(_bucketed(spark, d))


def unpriced_samples(spark: SparkSession, d: str) -> DataFrame:
    return C.unpriced_samples(traces.event_trace(spark, d))


def synthesized_samples(spark: SparkSession, d: str) -> DataFrame:
    return C.synthesized_samples(traces.event_trace(spark, d))


def cross_exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cross_task.exact_across(cross_task.candidates(traces.event_trace(spark, d))).select("task_id", "repeat_step", "original_task", "original_step")


def _unclaimed(spark: SparkSession, d: str) -> DataFrame:
    events = traces.event_trace(spark, d)
    return cross_task.exact_across(cross_task.candidates(events, repeats.exact_repeats(events)))


def cross_exact_unclaimed(spark: SparkSession, d: str) -> DataFrame:
    return _unclaimed(spark, d).select("task_id", "repeat_step", "original_task", "original_step")


def cross_split(spark: SparkSession, d: str) -> DataFrame:
    found = task_graph.components(task_graph.task_edges(traces.event_trace(spark, d)))
    return waste.with_component(_unclaimed(spark, d), found).groupBy("bucket").agg(F.count("*").alias("pairs"))


def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.by_bucket(waste.bucketed_pairs(traces.event_trace(spark, d)))


def task_edges(spark: SparkSession, d: str) -> DataFrame:
    return task_graph.task_edges(traces.event_trace(spark, d))


def task_components(spark: SparkSession, d: str) -> DataFrame:
    return task_graph.components(task_graph.task_edges(traces.event_trace(spark, d)))


def continuation_hops(spark: SparkSession, d: str) -> DataFrame:
    return task_graph.continuation_hops(task_graph.task_edges(traces.event_trace(spark, d))).select("tip", "hop", "successor", "predecessor")


def continuation_tips(spark: SparkSession, d: str) -> DataFrame:
    """Hops with their depth and how many chains share them."""
    found = task_graph.continuation_tips(task_graph.task_edges(traces.event_trace(spark, d)))
    return found.select("successor", "predecessor", "root", "depth", (F.col("last_tip") - F.col("first_tip") + 1).alias("tips"))


def shape_distance(spark: SparkSession, d: str) -> DataFrame:
    events = traces.event_trace(spark, d)
    hints = drift_hints(events, task_graph.task_edges(events))
    return hints.select("predecessor", "successor", "predecessor_calls", "successor_calls", "shape_distance", F.round("shape_fraction", 4).alias("shape_fraction"))


def drift_details(spark: SparkSession, d: str) -> DataFrame:
    events = traces.event_trace(spark, d)
    hints = drift_hints(events, task_graph.task_edges(events))
    steps = lambda c, of: F.array_join(F.transform(c, of), ",")
    one = lambda x: x["step_index"].cast("string")
    pair = lambda x: F.concat_ws("-", x["before"]["step_index"], x["after"]["step_index"])
    content = lambda x: F.concat_ws("-", x["before"], x["after"], x["distance"])
    return hints.select("predecessor", "successor", steps("added", one).alias("added"), steps("removed", one).alias("removed"), steps("substituted", pair).alias("substituted"), steps("content_distances", content).alias("content"))


def near_same_task(spark: SparkSession, d: str) -> DataFrame:
    events = traces.embedding_trace(spark, d)
    return repeats.near_repeats(events, repeats.exact_repeats(events), NEAR).select("task_id", "original_step", "repeat_step", "distance")


def _near_across(spark: SparkSession, d: str, window: int) -> DataFrame:
    found = cross_task.near_across(cross_task.candidates(traces.embedding_trace(spark, d)), NEAR, window)
    return found.select("task_id", "repeat_step", "original_task", "original_step", "distance")


def near_cross_task(spark: SparkSession, d: str) -> DataFrame:
    return _near_across(spark, d, cross_task.WINDOW)


def near_cross_task_bands(spark: SparkSession, d: str) -> DataFrame:
    """With a small window, so that most pairs are found by bands."""
    return _near_across(spark, d, SMALL_WINDOW)


def hamming(spark: SparkSession, d: str) -> DataFrame:
    marks = traces.embedding_trace(spark, d)
    order = W.partitionBy("task_id").orderBy("step_index")
    bits = repeats.fingerprint_bits("metadata.similarity_fingerprint")
    held = marks.select("task_id", "step_index", bits.alias("bits")).withColumn("before", F.lag("bits").over(order)).where("before is not null")
    return held.select("task_id", "step_index", F.bit_count(F.col("bits").bitwiseXOR(F.col("before"))).cast("int").alias("distance"))


def bands(spark: SparkSession, d: str) -> DataFrame:
    marks = traces.embedding_trace(spark, d).select("task_id", "step_index", repeats.fingerprint_bits("metadata.similarity_fingerprint").alias("bits"))
    return marks.select("task_id", "step_index", *[F.shiftrightunsigned("bits", 16 * i).bitwiseAND(F.lit(65535)).alias(f"band{i}") for i in range(4)])


def content_hash_text(spark: SparkSession, d: str) -> DataFrame:
    return traces.conversation_trace(spark, d).select("task_id", "step_index", "content_hash", "masked_spans")


def mask_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = hashing.with_content_hash(read_table(spark, d, "documents"), "text", "masked_hash", "spans", integers=True)
    return docs.select("doc_id", "masked_hash", "spans")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return hashing.with_normal_hash(read_table(spark, d, "documents"), "text").select("doc_id", "normal_hash")


def exact_duplicate_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").withColumn("hash", hashing.short_hash(F.col("text")))
    return docs.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def simhash_docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", hashing.fingerprint(F.col("text")).alias("fingerprint"))


def simhash_turns(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", hashing.fingerprint(F.col("text")).alias("fingerprint"))


def nearest_model_fill(spark: SparkSession, d: str) -> DataFrame:
    return joins.fill_from_nearest_call(traces.event_trace(spark, d)).select("task_id", "step_index", "model", "model_basis")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "events")
    return raw.select(F.col("user_id").alias("session"), F.col("ts").alias("at"), "event_id", "event_type", "value")


def prompt_window_claim(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d)
    starts = rows.where("event_type = 'signup'").select("session", "at", F.col("event_id").alias("start_id"))
    points = rows.where("event_type = 'view'").select("session", "at", F.col("event_id").alias("point_id"))
    return joins.claim_first_in_window(starts, points)


def turn_cost_asof(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d)
    points = rows.where("event_type = 'purchase'").select("session", "at", F.col("event_id").alias("point_id"))
    ends = rows.where("event_type = 'click'").select("session", "at", F.col("event_id").alias("end_id"))
    return joins.as_of(points, ends)


def positional_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d)
    side = lambda kind: rows.where(F.col("event_type") == kind).select("session", "at", F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 2).alias("name"))
    return joins.positional(side("click"), side("purchase"))


def greedy_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = _sessions(spark, d)
    calls = rows.where("event_type = 'view'").select(F.col("session").alias("trace"), F.col("at").alias("end"), F.col("event_id").alias("call_id"))
    ends = rows.where("event_type = 'click'").select(F.col("session").alias("trace"), F.col("at").alias("end"), F.col("event_id").alias("end_id"))
    return joins.pair_greedily(calls, ends)


def orphan_cost_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return joins.unmatched(orders, lines, ["key"])


def _generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = read_table(spark, d, "orders")
    points = orders.select((F.col("o_custkey") % 50).alias("channel"), F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("start"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("value"))
    starts = points.where("start % 2 = 0").select("channel", "model", "start").distinct()
    calls = points.select("channel", "model", F.col("start").alias("at"), F.col("at").alias("call_id"))
    return points, starts, calls


def latest_counter_points(spark: SparkSession, d: str) -> DataFrame:
    return joins.latest_points(_generations(spark, d)[0])


def restart_windows(spark: SparkSession, d: str) -> DataFrame:
    return joins.generation_windows(_generations(spark, d)[1])


def restart_window_calls(spark: SparkSession, d: str) -> DataFrame:
    _, starts, calls = _generations(spark, d)
    return joins.to_generation(calls, starts).groupBy("channel", "model", "start").agg(F.count("*").alias("calls"), F.sum("call_id").alias("ids"))


def cost_apportion(spark: SparkSession, d: str) -> DataFrame:
    total = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("usd"))
    calls = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("call_id"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_quantity").cast("long")).otherwise(F.lit(0)).alias("tokens"))
    return joins.apportion(total, calls, ["key"])


def sibling_chain_watermark(spark: SparkSession, d: str) -> DataFrame:
    spans = traces.order_spans(spark, d)
    return joins.chain_siblings(spans.groupBy("parent", "span_id").agg(F.min("start").alias("start"), F.max("end").alias("end")))


def sibling_chain(spark: SparkSession, d: str) -> DataFrame:
    spans = traces.order_spans(spark, d).groupBy("parent", "span_id").agg(F.min("start").alias("start"))
    return joins.chain_all(spans)


def nearest_kept_ancestor(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("long").alias("span_id")).agg(F.max("l_returnflag").alias("flag"))
    spans = lines.select("trace", "span_id", F.when(F.col("span_id") > 1, F.expr("span_id div 2")).alias("parent_id"), (F.col("flag") == "N").alias("kept"))
    return joins.nearest_kept_ancestor(spans)


def price_estimate(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part")
    prices = parts.groupBy(F.col("p_type").alias("model")).agg((F.min("p_retailprice") / 1000).alias("input"), (F.max("p_retailprice") / 1000).alias("output"), F.lit(None).cast("double").alias("cache_read"), F.lit(None).cast("double").alias("cache_write"))
    events = parts.select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("model"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("tokens_in"), F.when(F.col("p_partkey") % 2 > 0, F.col("p_size")).alias("tokens_out"))
    return pricing.estimate(events, prices).select("p_partkey", F.round("estimated_usd", 4).alias("estimated_usd"))


def hash_spec_guard(spark: SparkSession, d: str) -> DataFrame:
    from .sources.jsonl import spec_counts

    return spec_counts(traces.event_trace(spark, d))


def sessions_detected(spark: SparkSession, d: str) -> DataFrame:
    """Boolean aggregates over one pass, as source detection does."""
    raw = read_table(spark, d, "events")
    return raw.groupBy("user_id").agg(F.max(F.col("event_type").startswith("sign")).alias("has_signup"), F.max(F.col("event_type") == "error").alias("has_error"), F.min(F.col("event_type").isin("view", "click", "purchase")).alias("only_calls"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        verdict_counts, effective_parent, terminal_outcome, call_filter, exact_repeat_pairs, call_result_link, write_signal, result_signal, pair_verdicts, verdict_reasons,
        slice_grouping_sets, slice_by_model, slice_by_workflow, coverage, cost_by_basis, comparability, verdicts_reached, top_highlights, sample_reasons, unpriced_samples, synthesized_samples,
        cross_exact_pairs, cross_exact_unclaimed, cross_split, bucket_counts, task_edges, task_components, continuation_hops, continuation_tips, shape_distance, drift_details,
        near_same_task, near_cross_task, near_cross_task_bands, hamming, bands, content_hash_text, mask_counts, normalize_text, exact_duplicate_docs, simhash_docs, simhash_turns,
        nearest_model_fill, prompt_window_claim, turn_cost_asof, positional_join, greedy_pairing, orphan_cost_rows, latest_counter_points, restart_windows, restart_window_calls,
        cost_apportion, sibling_chain_watermark, sibling_chain, nearest_kept_ancestor, price_estimate, hash_spec_guard, sessions_detected,
    )
}
