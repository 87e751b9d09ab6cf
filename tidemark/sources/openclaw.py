"""OpenClaw's spans, with costs apportioned from its cumulative cost counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import apportion, latest_points, to_generation
from . import otlp
from .convert import Chain, ancestors, at_nanos, event, first, grouped, hashed, marks, opaque, whole

NAME = "openclaw"

# Span names, attribute names, the counter.
CALL, TOOL, HARNESS = "openclaw.model.call", "openclaw.tool.execution", "openclaw.harness.run"
UNIT, COUNTER = "openclaw.model_call.observation_unit", "openclaw.cost.usd"
MODEL, TOOL_NAME = ("gen_ai.request.model", "openclaw.model"), ("gen_ai.tool.name", "openclaw.toolName")
CACHE = ("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_creation.input_tokens")


SIGNALS = (("span name openclaw.* or its observation unit", lambda r: (r.kind == "span") & (r.name.startswith("openclaw.") | r.attributes.getItem(UNIT).isNotNull())),)


def outcome(span: dict) -> str | None:
    a = span["attributes"]
    if first(a, "openclaw.errorCategory", "error.type") is not None or a.get("openclaw.outcome") == "blocked":
        return "error"
    return "ok" if span["end"] is not None else None


def workflow(span: dict, by_id: dict[str, dict]) -> str | None:
    for above in ancestors(span, by_id):
        if above["name"] == HARNESS:
            return above["attributes"].get("openclaw.harness.id") or above["name"]
    return span["attributes"].get("openclaw.channel") or None


def content(span: dict, key: str) -> tuple[str, dict]:
    """(hash, metadata) of a captured value; what wasn't captured is opaque and has no fingerprint."""
    value = span["attributes"].get(key)
    if value is None:
        return opaque(span["span_id"]), {"content_basis": "opaque"}
    return hashed(value, True), {"content_basis": "prompt", **marks(value, True)}


def convert_trace(spans: list[dict]) -> list[dict]:
    by_id, chain, out = {s["span_id"]: s for s in spans}, Chain(), []
    for s in sorted((s for s in spans if s["name"] in (CALL, TOOL)), key=lambda s: (s["start"], str(s["ordinal"]))):
        a, step, task = s["attributes"], len(out), s["trace_id"]
        above, parent = chain.parent((x["span_id"] for x in ancestors(s, by_id)), s["start"])
        known = {"workflow": workflow(s, by_id), "ts": at_nanos(s["start"])}
        if s["name"] == CALL:
            name, (own, meta) = first(a, *MODEL), content(s, "gen_ai.input.messages")
            said, given = a.get("gen_ai.output.messages"), a.get("gen_ai.usage.input_tokens")
            meta |= {"response_hash": None if said is None else hashed(said, True), "task_id_source": "trace_id_fallback"}
            tokens = None if given is None else whole(given) + sum(whole(a.get(k)) or 0 for k in CACHE)
            out.append(event(task, step, "llm_call", name or s["name"], own, meta=meta, parent_id=parent, model=name, outcome=outcome(s), tokens_in=tokens, tokens_out=whole(a.get("gen_ai.usage.output_tokens")), **known))
        else:
            name, (own, meta) = first(a, *TOOL_NAME) or s["name"], content(s, "gen_ai.tool.call.arguments")
            meta["task_id_source"] = "trace_id_fallback"
            out.append(event(task, step, "tool_call", name, own, meta=meta, parent_id=parent, outcome="error" if a.get("openclaw.outcome") == "blocked" else None, **known))
            result = a.get("gen_ai.tool.call.result")
            if result is not None:
                step, known["ts"] = step + 1, at_nanos(s["end"] or s["start"])
                out.append(event(task, step, "tool_result", name, hashed(result, True), meta={"content_basis": "prompt", "task_id_source": "trace_id_fallback"}, parent_id=step - 1, outcome=outcome(s), **known))
        chain.add(s["span_id"], above, s["end"] or s["start"], step)
    return out


def with_costs(events: DataFrame, channels: DataFrame, points: DataFrame) -> DataFrame:
    """Model calls get their share of the counter generation they fall into, by tokens, or equal shares."""
    none = F.lit("\0")
    counter = points.where((F.col("name") == COUNTER) & (F.col("kind") == "sum") & (F.col("temporality") == "cumulative"))
    counter = counter.select(F.coalesce(F.col("attributes").getItem("openclaw.channel"), none).alias("channel"), F.coalesce(F.col("attributes").getItem("openclaw.model"), none).alias("model"), "start", "at", F.coalesce("value", F.lit(0.0)).alias("value"))
    total = latest_points(counter).withColumnRenamed("value", "usd")
    named = events.join(channels, "task_id", "left").withColumn("channel", F.coalesce("channel", none)).withColumn("_id", F.concat_ws("\0", "task_id", "step_index"))
    tokens = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))
    calls = named.where("event_type = 'llm_call'").select("channel", F.coalesce("model", none).alias("model"), (F.unix_micros("ts") * 1000).alias("at"), F.col("_id").alias("call_id"), tokens.alias("tokens"))
    placed = to_generation(calls, total.select("channel", "model", "start")).join(calls.select("call_id", "tokens"), "call_id")
    shares = apportion(total, placed, ["channel", "model", "start"])
    by_tokens = placed.withColumn("_t", F.sum("tokens").over(W.partitionBy("channel", "model", "start")) > 0).select("call_id", "_t")
    shares = shares.join(by_tokens, "call_id").select(F.col("call_id").alias("_id"), "usd", "_t")
    basis = F.when(F.col("_t"), "apportioned_from_metrics_by_tokens").otherwise("apportioned_from_metrics_equal_split")
    out = named.join(shares, "_id", "left").withColumn("cost_usd", F.coalesce("usd", "cost_usd"))
    return out.withColumn("metadata", F.when(F.col("usd").isNotNull(), F.col("metadata").withField("cost_basis", basis)).otherwise(F.col("metadata"))).select(*events.columns)


def convert(docs: DataFrame) -> DataFrame:
    spans = otlp.spans(docs)
    channel = F.col("attributes").getItem("openclaw.channel")
    channels = spans.where(channel != "").groupBy(F.col("trace_id").alias("task_id")).agg(F.min(F.struct("ordinal", channel.alias("c")))["c"].alias("channel"))
    return with_costs(grouped(spans, "trace_id", convert_trace), channels, otlp.metric_points(docs))
