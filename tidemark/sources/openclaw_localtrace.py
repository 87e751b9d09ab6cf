"""The local trace plugin's spans: flat runs, content on a companion span, costs a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import as_of
from . import otlp
from .convert import at_nanos, event, fill_models, grouped, hashed, marks, number, opaque, whole
from .openclaw import CACHE

NAME = "openclaw-localtrace"

# Span names, the gauge.
PREFIX = "openclaw-localtrace."
RUN, CONTENT, CALL, TOOL = (PREFIX + n for n in ("run", "llm.call", "model.call", "tool.execution"))
GAUGE = "openclaw.turn.cost.usd"


SIGNALS = ((f"span name {PREFIX}* or service.name", lambda r: (r.kind == "span") & (r.name.startswith(PREFIX) | (r.resource.getItem("service.name") == NAME))),)


def _end(span: dict) -> int:
    return span["end"] if span["end"] is not None else span["start"]


def pair(calls: list[dict], contents: list[dict]) -> dict[str, dict]:
    """Content spans by the call they enrich: the last unclaimed one that ended before them."""
    free, out, calls = [], {}, sorted(calls, key=_end)
    at = 0
    for content in sorted(contents, key=_end):
        while at < len(calls) and _end(calls[at]) <= _end(content):
            free.append(calls[at])
            at += 1
        if free:
            out[free.pop()["span_id"]] = content
    return out



def _workflow(run: dict | None) -> str:
    a = run["attributes"] if run else {}
    return a.get("openclaw.agentId") or a.get("openclaw.channel") or a.get("openclaw.channelId") or "main"


def convert_task(spans: list[dict]) -> list[dict]:
    """Events of one session: its traces in reading order, each in order of start."""
    traces: dict[str, list[dict]] = {}
    for s in sorted(spans, key=lambda s: str(s["ordinal"])):
        traces.setdefault(s["trace_id"], []).append(s)
    out: list[dict] = []
    for trace in traces.values():
        task, flow = spans[0]["task"], _workflow(next((s for s in trace if s["name"] == RUN), None))
        calls = sorted((s for s in trace if s["name"] == CALL), key=lambda s: s["start"])
        content = pair(calls, [s for s in trace if s["name"] == CONTENT])
        for s in sorted((s for s in trace if s["name"] in (CALL, TOOL)), key=lambda s: (s["start"], s["name"] != CALL)):
            a, step = s["attributes"], len(out)
            source = "conversation_id" if a.get("openclaw.sessionId") else "trace_id_fallback"
            known = {"workflow": flow, "ts": at_nanos(s["start"])}
            ended = "ok" if s["end"] is not None else None
            if s["name"] == CALL:
                c = content.get(s["span_id"], {}).get("attributes", {})
                given, said, tokens, cost = c.get("gen_ai.input.messages"), c.get("gen_ai.output.messages"), c.get("gen_ai.usage.input_tokens"), number(c.get("gen_ai.usage.cost_usd"))
                meta = {"task_id_source": source, "response_hash": None if said is None else hashed(said, True), "content_basis": "opaque" if given is None else "prompt", "cost_basis": None if cost is None else "estimated_from_bundled_pricing_table"}
                meta |= {} if given is None else marks(given, True)
                tokens = None if tokens is None else whole(tokens) + sum(whole(c.get(k)) or 0 for k in CACHE)
                model = a.get("openclaw.model")
                out.append(event(task, step, "llm_call", model or s["name"], opaque(s["span_id"]) if given is None else hashed(given, True), meta=meta, model=model, tokens_in=tokens, tokens_out=whole(c.get("gen_ai.usage.output_tokens")), cost_usd=cost, outcome="error" if a.get("openclaw.errorCategory") else ended, **known))
                continue
            name, given, error, result = a.get("openclaw.toolName") or s["name"], a.get("gen_ai.tool.call.arguments"), a.get("openclaw.error"), a.get("gen_ai.tool.call.result")
            meta = {"task_id_source": source, "content_basis": "opaque" if given is None else "prompt", "write": {"true": True, "false": False}.get(a.get("openclaw.mutatingAction"))}
            meta |= {} if given is None else marks(given, True)
            out.append(event(task, step, "tool_call", name, opaque(s["span_id"]) if given is None else hashed(given, True), meta=meta, outcome="error" if error else None, **known))
            if result is not None:
                known["ts"] = at_nanos(_end(s))
                out.append(event(task, step + 1, "tool_result", name, hashed(result, True), meta={"task_id_source": source, "content_basis": "prompt"}, outcome="error" if error else ended, **known))
    return fill_models(out)


def with_turn_costs(events: DataFrame, runs: DataFrame, points: DataFrame) -> DataFrame:
    """Each turn's dollars go to the calls, without a cost of their own, of the session's last run that ended before.

    runs: task_id, run, start, end; calls belong to the run in which they started.
    """
    session = F.col("attributes").getItem("openclaw.sessionId")
    turns = points.where((F.col("name") == GAUGE) & (F.col("kind") == "gauge") & F.col("value").isNotNull() & (session != ""))
    turns = turns.select(session.alias("session"), "at", F.to_json("ordinal").alias("point_id"), "value")
    met = as_of(turns.drop("value"), runs.select(F.col("task_id").alias("session"), F.col("end").alias("at"), F.col("run").alias("end_id"))).where("end_id is not null")
    spent = met.join(turns.select("session", "point_id", "value"), ["session", "point_id"]).groupBy(F.col("session").alias("task_id"), F.col("end_id").alias("run")).agg(F.sum("value").alias("usd"))
    named = events.withColumn("_id", F.concat_ws("\0", "task_id", "step_index"))
    calls = named.where("event_type = 'llm_call' and cost_usd is null").select("task_id", "_id", F.unix_micros("ts").alias("at"), (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    placed = as_of(calls.select(F.col("task_id").alias("session"), "at", F.col("_id").alias("point_id")), runs.select(F.col("task_id").alias("session"), F.expr("start div 1000").alias("at"), F.col("run").alias("end_id")))
    calls = calls.join(placed.select(F.col("point_id").alias("_id"), F.col("end_id").alias("run")), "_id").join(spent, ["task_id", "run"])
    from pyspark.sql import Window as W

    own = W.partitionBy("task_id", "run")
    total = F.sum("tokens").over(own)
    part = F.when(total > 0, F.col("usd") * F.col("tokens") / total).otherwise(F.col("usd") / F.count("*").over(own))
    basis = F.when(total > 0, "apportioned_from_metrics_by_tokens").otherwise("apportioned_from_metrics_equal_split")
    shares = calls.select("_id", F.round(part, 6).alias("_usd"), basis.alias("_basis"))
    out = named.join(shares, "_id", "left").withColumn("cost_usd", F.coalesce("_usd", "cost_usd"))
    return out.withColumn("metadata", F.when(F.col("_usd").isNotNull(), F.col("metadata").withField("cost_basis", F.col("_basis"))).otherwise(F.col("metadata"))).select(*events.columns)


def convert(docs: DataFrame) -> DataFrame:
    spans = otlp.spans(docs)
    session = F.col("attributes").getItem("openclaw.sessionId")
    tasks = spans.groupBy("trace_id").agg(F.coalesce(F.min(F.when(session != "", F.struct("ordinal", session.alias("s"))))["s"], F.col("trace_id")).alias("task"))
    spans = spans.join(tasks, "trace_id")
    events = grouped(spans, "task", convert_task)
    kept = spans.where(F.col("name").isin(RUN, CALL, TOOL))
    runs = kept.groupBy(F.col("task").alias("task_id"), F.col("trace_id").alias("run")).agg(F.min("start").alias("start"), F.max(F.coalesce("end", "start")).alias("end"), F.max(F.col("name") == CALL).alias("_calls")).where("_calls").drop("_calls")
    return with_turn_costs(events, runs, otlp.metric_points(docs))
