"""Queries over telemetry made from the tables: reading, flattening, detection and the seven converters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, pricing
from .operators import lineage, repeats
from .plans import telemetry, traces, waste
from .sources import coding_cli, cowork, jsonl, openclaw, openclaw_localtrace, opencode, openinference, otlp, pi
from .sources.detect import signals
from .sources.summary import summary
from .tables import read_table, shared_path

PRICES = {"m1": {"input": 0.001, "output": 0.002}, "m2": {"input": 0.003, "output": 0.004, "cache_read": 0.0005, "cache_write": 0.25}}


def _shown(events: DataFrame, *more: str) -> DataFrame:
    """What an event holds, without the hashes of what has no content."""
    hidden = F.col("metadata.content_basis").isin("opaque", "log_only_no_span")
    every = {
        "task_id": "task_id", "step_index": "step_index", "event_type": "event_type", "name": "name", "hash": F.when(~F.coalesce(hidden, F.lit(False)), F.col("content_hash")), "tokens_in": "tokens_in", "tokens_out": "tokens_out",
        "outcome": "outcome", "at": F.unix_millis("ts"), "usd": F.round("cost_usd", 6), "model": "model", "parent_id": "parent_id", "workflow": "workflow", "basis": "metadata.content_basis", "cost_basis": "metadata.cost_basis",
        "model_basis": "metadata.model_basis", "task_source": "metadata.task_id_source", "response": "metadata.response_hash", "parent_task": "metadata.parent_task_id", "link": "metadata.parent_task_link_kind", "write": "metadata.write",
        "billing_only": "metadata.synthesized_cost_only",
    }
    names = ("task_id", "step_index", "event_type", "name", "outcome", "at", "usd", "model", "parent_id", "workflow", "tokens_in", "tokens_out", *more)
    return events.select(*[(F.col(c) if isinstance(c := every[n], str) else c).alias(n) for n in names])


def _docs(files: DataFrame) -> DataFrame:
    return otlp.with_kinds(files)


def openinference_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(openinference.convert(_docs(telemetry.openinference_documents(spark, d)), PRICES), "hash", "cost_basis", "model_basis", "task_source")


def openinference_skipped(spark: SparkSession, d: str) -> DataFrame:
    return openinference.skipped(_docs(telemetry.openinference_documents(spark, d)))


def coding_cli_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(coding_cli.convert(_docs(telemetry.coding_cli_documents(spark, d))), "hash", "basis", "model_basis", "task_source", "billing_only")


def subagent_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of tasks handed to subagents, under their names."""
    found = coding_cli.convert(_docs(telemetry.subagent_documents(spark, d)))
    return found.select("task_id", "step_index", "event_type", "name", "workflow", "parent_id")


def cowork_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(cowork.convert(_docs(telemetry.cowork_documents(spark, d))), "hash", "basis", "response")


def openclaw_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(openclaw.convert(_docs(telemetry.openclaw_documents(spark, d))), "hash", "basis", "cost_basis", "response")


def openclaw_localtrace_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(openclaw_localtrace.convert(_docs(telemetry.localtrace_documents(spark, d))), "hash", "basis", "cost_basis", "model_basis", "task_source", "write")


def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of JSON values written in several ways, and of texts that aren't JSON."""
    rows, k = telemetry.session_rows(spark, d), F.col("k").cast("string")
    value = F.concat(F.lit('{"b" : 1.0, "a":[ '), k, F.lit(', 2.50,true ], "c": {"y": null, "x": "é\\u00e9 '), F.col("word"), F.lit('"}}'))
    text = F.when(F.col("k") % 10 == 0, F.concat(F.lit("{broken  "), F.col("word"))).otherwise(value)
    return rows.select("event_id", hashing.hash_structured(text)["hash"].alias("hash"))


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events with their place of origin, written as JSON lines in the shared folder and read again."""
    path = shared_path(spark, "events")
    events = traces.event_trace(spark, d)
    jsonl.write_events(jsonl.with_source_path(events.withColumn("ts", F.col("ts").cast("timestamp")), "/in/folder"), path)
    found = jsonl.read_events(spark, path).events
    return found.select("task_id", "step_index", "event_type", "content_hash", "tokens_in", "tokens_out", "outcome", F.unix_micros("ts").alias("at"), "cost_usd", "model", "workflow", F.col("metadata.write").alias("write"), F.col("metadata.source_path").alias("source_path"))


def opencode_table_events(spark: SparkSession, d: str) -> DataFrame:
    """The sessions of opencode_events from the tables of a database."""
    return _opencode(opencode.from_tables(**telemetry.opencode_tables(spark, d)))


def opencode_events(spark: SparkSession, d: str) -> DataFrame:
    return _opencode(opencode.exports(telemetry.opencode_files(spark, d)))


def _opencode(sessions: DataFrame) -> DataFrame:
    return _shown(opencode.convert(sessions, PRICES), "hash", "basis", "cost_basis", "model_basis", "parent_task", "link", "response")


def pi_events(spark: SparkSession, d: str) -> DataFrame:
    return _shown(pi.convert(pi.sessions(telemetry.pi_files(spark, d)), PRICES), "hash", "basis", "cost_basis", "model_basis", "parent_task", "link", "billing_only", "response")


def otlp_documents(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents of two sources, one with spans and logs and one with spans and metrics."""
    docs = _docs(telemetry.coding_cli_documents(spark, d).unionByName(telemetry.openclaw_documents(spark, d)))
    return docs.groupBy("is_trace", "is_log", "is_metrics").agg(F.count("*").alias("documents"))


def otlp_spans(spark: SparkSession, d: str) -> DataFrame:
    rows, a = otlp.spans(_docs(telemetry.coding_cli_documents(spark, d))), F.col("attributes")
    said = F.col("events")[0]["attributes"].getItem("content")
    return rows.select("trace_id", "span_id", "parent_id", "name", F.expr("start div 1000000000").alias("start"), F.expr("end div 1000000000").alias("end"), a.getItem("model").alias("model"), a.getItem("input_tokens").alias("input_tokens"), a.getItem("success").alias("success"), F.when(F.size("events") > 0, said).alias("said"), F.col("resource").getItem("service.name").alias("service"))


def otlp_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return otlp.spans(_docs(telemetry.openinference_documents(spark, d))).groupBy("name", "outcome").agg(F.count("*").alias("spans"), F.sum(F.size("attributes")).alias("attributes"))


def otlp_logs(spark: SparkSession, d: str) -> DataFrame:
    rows, a = otlp.logs(_docs(telemetry.cowork_documents(spark, d))), F.col("attributes")
    return rows.select(F.expr("at div 1000000000").alias("at"), *[a.getItem(k).alias(k.replace(".", "_")) for k in ("session.id", "event.name", "event.sequence", "prompt", "tool_parameters")], F.round(a.getItem("cost_usd").cast("double"), 6).alias("cost"), F.col("resource").getItem("service.name").alias("service"))


def otlp_metric_points(spark: SparkSession, d: str) -> DataFrame:
    rows, a = otlp.metric_points(_docs(telemetry.order_metrics(spark, d))), F.col("attributes")
    return rows.select(F.col("ordinal.file").alias("file"), "name", "kind", F.round("value", 4).alias("value"), F.expr("start div 1000000000").alias("start"), F.expr("at div 1000000000").alias("at"), "temporality", "monotonic", a.getItem("model").alias("model"), a.getItem("model.again").alias("again"))


def source_signals(spark: SparkSession, d: str) -> DataFrame:
    """What each source's detection sees in each source's telemetry."""
    made = {
        "coding_cli": telemetry.coding_cli_documents, "cowork": telemetry.cowork_documents, "openclaw": telemetry.openclaw_documents,
        "localtrace": telemetry.localtrace_documents, "openinference": telemetry.openinference_documents,
    }
    out = None
    for name, documents in made.items():
        found = signals(_docs(documents(spark, d)))
        kinds = {"span_names": "claude-code:0", "service": "claude-code:1", "cowork": "cowork:0", "openclaw": "openclaw:0", "localtrace": "openclaw-localtrace:0", "openinference": "openinference:0"}
        found = found.select(F.lit(name).alias("telemetry"), *[F.col(f"`{c}`").alias(as_) for as_, c in kinds.items()], "residual")
        out = found if out is None else out.unionByName(found)
    return out


def jsonl_rows(spark: SparkSession, d: str) -> DataFrame:
    """Event lines, some of them bad, as validation reads them."""
    rows, k = telemetry.session_rows(spark, d), F.col("k")
    step = F.when(k % 11 == 0, F.lit("first")).when(k % 3 == 0, (F.col("n") + 0.5).cast("string")).otherwise(F.col("n").cast("string"))
    kind = F.when(k % 13 == 0, "call").otherwise("llm_call")
    meta = F.when(k % 2 == 0, F.to_json(F.struct((k % 4 == 0).alias("write"), text_of(k).alias("response_hash"))))
    fields = F.struct(
        F.when(k % 17 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("task_id"), step.alias("step_index"), kind.alias("event_type"), F.col("event_type").alias("name"), F.col("word").alias("content_hash"),
        F.when(k % 19 == 0, F.lit("many")).otherwise((k * 10).cast("string")).alias("tokens_in"), F.when(k % 5 == 0, F.lit("")).when(k % 23 == 0, "maybe").otherwise("ok").alias("outcome"), F.col("at").alias("timestamp"),
    )
    line = F.when(k % 29 == 0, F.lit("{broken")).otherwise(_with_metadata(F.to_json(fields), meta))
    found = jsonl.parse(rows.select("event_id", line.alias("value")))
    good = F.col("_error").isNull()
    return found.select("event_id", "_error", *[F.when(good, F.col(c)).alias(c) for c in ("task_id", "step_index", "event_type", "tokens_in", "outcome")], F.when(good, F.unix_seconds("ts")).alias("at"), F.when(good, F.col("metadata.write")).alias("write"), F.when(good, F.col("metadata.response_hash")).alias("response")).withColumnRenamed("_error", "error")


def text_of(number: F.Column) -> F.Column:
    return F.concat(F.lit("h"), number.cast("string"))


def _with_metadata(line: F.Column, meta: F.Column) -> F.Column:
    return F.coalesce(F.concat(F.regexp_replace(line, r"\}$", ""), F.lit(', "metadata": '), meta, F.lit("}")), line)


def price_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A table of prices with an override, and what calls cost by it, cache reads and writes included."""
    parts = read_table(spark, d, "part")
    rates = lambda rows, factor: rows.groupBy(F.col("p_type").alias("model")).agg((F.min("p_retailprice") * factor).alias("input"), (F.max("p_retailprice") * factor).alias("output"), F.min(F.when(F.col("p_size") > 10, F.col("p_size") / 100)).alias("cache_read"), F.lit(None).cast("double").alias("cache_write"))
    table = pricing.overlaid(rates(parts.where("p_partkey % 7 > 0"), 0.001), rates(parts.where("p_partkey % 5 = 0"), 0.5))
    calls = parts.select("p_partkey", F.col("p_type").alias("model"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("tokens_in"), F.lit(None).cast("int").alias("tokens_out"), F.col("p_size").alias("_read"))
    return pricing.estimate(calls, table, cache_read=F.col("_read"), cache_write=F.col("_read")).select("p_partkey", F.round("estimated_usd", 4).alias("estimated_usd"))


def price_curation(spark: SparkSession, d: str) -> DataFrame:
    """A listing of prices reduced to own models of chosen providers with both rates."""
    parts = read_table(spark, d, "part")
    prefix = F.when(F.col("p_partkey") % 4 == 0, "azure/").otherwise("")
    listing = parts.select(F.concat(prefix, F.lit("m"), F.col("p_partkey").cast("string")).alias("model"), F.when(F.col("p_partkey") % 3 == 0, "someone").otherwise("openai").alias("provider"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice")).alias("input"), F.col("p_retailprice").alias("output"))
    return pricing.curate(listing).select("model", F.round("input", 4).alias("input"))


def conversion_summary(spark: SparkSession, d: str) -> DataFrame:
    """What conversions of two sources made."""
    one = openinference.convert(_docs(telemetry.openinference_documents(spark, d)), PRICES)
    other = opencode.convert(opencode.exports(telemetry.opencode_files(spark, d)), PRICES)
    return summary(one).withColumn("source", F.lit("openinference")).unionByName(summary(other).withColumn("source", F.lit("opencode")))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return traces.event_tree(spark, d)


def tree_effective_parent(spark: SparkSession, d: str) -> DataFrame:
    placed = repeats.placed_events(_tree(spark, d))
    return placed.select("task_id", "step_index", "eff_parent", "branching")


def tree_exact_repeats(spark: SparkSession, d: str) -> DataFrame:
    return repeats.exact_repeats(_tree(spark, d)).select("task_id", "original_step", "repeat_step", "original_result", "repeat_result", "write_step", "unknown_step", "terminal_outcome")


def tree_near_repeats(spark: SparkSession, d: str) -> DataFrame:
    events = _tree(spark, d)
    return repeats.near_repeats(events, repeats.exact_repeats(events), 30).select("task_id", "original_step", "repeat_step", "distance")


def tree_terminal_outcome(spark: SparkSession, d: str) -> DataFrame:
    return lineage.terminal_outcomes(_tree(spark, d))


def pair_notes(spark: SparkSession, d: str) -> DataFrame:
    from .operators import coverage as C

    events = traces.event_trace(spark, d)
    return C.pair_notes(events, waste.bucketed_pairs(events))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        openinference_events, openinference_skipped, coding_cli_events, subagent_events, cowork_events, openclaw_events, openclaw_localtrace_events, opencode_events, opencode_table_events, pi_events, canonical_json, jsonl_round_trip, conversion_summary,
        otlp_documents, otlp_spans, otlp_outcomes, otlp_logs, otlp_metric_points, source_signals, jsonl_rows, price_overlay, price_curation,
        tree_effective_parent, tree_exact_repeats, tree_near_repeats, tree_terminal_outcome, pair_notes,
    )
}
