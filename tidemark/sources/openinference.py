"""Spans with OpenInference kinds: model and tool spans become events."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import otlp
from .convert import Chain, ancestors, at_nanos, event, fill_models, first, grouped, hashed, looks_structured, number, priced, whole

NAME, PRICED = "openinference", True

# Attribute names in order of preference.
KIND = "openinference.span.kind"
CONVERSATION = ("gen_ai.conversation.id", "session.id")
PARENT_TASK = ("hermes.subagent.parent_session_id",)
AGENT = ("agent.name", "gen_ai.agent.name")
MODEL = ("llm.model_name", "gen_ai.request.model")
TOKENS = {
    "in": ("llm.token_count.prompt", "gen_ai.usage.input_tokens"),
    "out": ("llm.token_count.completion", "gen_ai.usage.output_tokens"),
    "read": ("llm.token_count.prompt_details.cache_read", "gen_ai.usage.cache_read_input_tokens", "gen_ai.usage.cache_read.input_tokens"),
    "write": ("llm.token_count.prompt_details.cache_write", "gen_ai.usage.cache_creation_input_tokens", "gen_ai.usage.cache_creation.input_tokens"),
}
COST = ("llm.cost.total", "cost.total_usd")

_RESOLVED = "trace_id string, span_id string, task_id string, task_source string, parent_task string, workflow string, above array<string>, tokens array<string>, donor_model string"


SIGNALS = ((f"span attribute {KIND}", lambda r: (r.kind == "span") & r.attributes.getItem(KIND).isNotNull()),)


def kind_of(span: dict) -> str | None:
    kind = span["attributes"].get(KIND)
    return kind.upper() if kind else None


def resolve(spans: list[dict]) -> Iterable[dict]:
    """What a span takes from its trace: task, parent task, workflow, ancestors, tokens of a child without content."""
    by_id = {s["span_id"]: s for s in spans}
    children: dict[str, list[dict]] = {}
    for s in spans:
        children.setdefault(s["parent_id"], []).append(s)
    for s in spans:
        line = [s, *ancestors(s, by_id)]
        task = next((v for a in line if (v := first(a["attributes"], *CONVERSATION)) is not None), None)
        agents = [a for a in line[1:] if kind_of(a) in ("AGENT", "CHAIN")]
        named = next((v for a in agents if (v := first(a["attributes"], *AGENT))), None)
        tokens, model = [first(s["attributes"], *keys) for keys in TOKENS.values()], None
        if tokens[0] is None and tokens[1] is None:
            gives = (c for c in children.get(s["span_id"], ()) if kind_of(c) == "LLM" and c["attributes"].get("input.value") is None)
            donor = next((c for c in gives if first(c["attributes"], *TOKENS["in"], *TOKENS["out"]) is not None), None)
            if donor:
                tokens, model = [first(donor["attributes"], *keys) for keys in TOKENS.values()], first(donor["attributes"], *MODEL)
        yield {
            "trace_id": s["trace_id"], "span_id": s["span_id"], "task_id": task if task is not None else s["trace_id"], "task_source": "conversation_id" if task is not None else "trace_id_fallback",
            "parent_task": next((v for a in line if (v := first(a["attributes"], *PARENT_TASK)) is not None), None),
            "workflow": named or (agents[0]["name"] if agents else "main"), "above": [a["span_id"] for a in line[1:]], "tokens": tokens, "donor_model": model,
        }


def convert_task(spans: list[dict], prices: dict | None = None) -> list[dict]:
    """Events of one task, in order of start."""
    chain, out = Chain(), []
    for s in sorted(spans, key=lambda s: (s["start"], str(s["ordinal"]))):
        a, given = s["attributes"], s["attributes"].get("input.value")
        if given is None:
            continue
        above, parent = chain.parent(s["above"], s["start"])
        end = s["end"] or s["start"]
        meta = {"task_id_source": s["task_source"], "parent_task_id": s["parent_task"]}
        known = {"workflow": s["workflow"], "ts": at_nanos(s["start"])}
        content, step = hashed(given, looks_structured(a.get("input.mime_type"), given)), len(out)
        if kind_of(s) == "LLM":
            model, tokens = first(a, *MODEL) or s["donor_model"], [whole(t) for t in s["tokens"]]
            cost, basis = priced(number(first(a, *COST)), prices, model, *tokens)
            out.append(event(s["task_id"], step, "llm_call", model or s["name"], content, meta=meta | basis, parent_id=parent, model=model, outcome=s["outcome"], tokens_in=tokens[0], tokens_out=tokens[1], cost_usd=cost, **known))
        else:
            name, result = a.get("tool.name") or s["name"], a.get("output.value")
            out.append(event(s["task_id"], step, "tool_call", name, content, meta=meta, parent_id=parent, **known))
            if result is not None:
                known["ts"] = at_nanos(end)
                step += 1
                out.append(event(s["task_id"], step, "tool_result", name, hashed(result, looks_structured(a.get("output.mime_type"), result)), meta=meta, parent_id=step - 1, outcome=s["outcome"], **known))
        chain.add(s["span_id"], above, end, step)
    return fill_models(out)


def convert(docs: DataFrame, prices: dict | None = None) -> DataFrame:
    """Events of all trace documents; costs that no span reports are estimated from a price table."""
    from .convert import _plain

    spans = otlp.spans(docs)

    def resolved(group: pa.Table) -> pa.Table:
        rows = list(resolve([_plain(r) for r in group.to_pylist()]))
        text, texts = pa.string(), pa.list_(pa.string())
        kinds = [text, text, text, text, text, text, texts, texts, text]
        names = [c.split()[0] for c in _RESOLVED.split(", ")]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(names, kinds, strict=True))))

    found = spans.groupBy("trace_id").applyInArrow(resolved, _RESOLVED)
    kept = spans.where(F.upper(F.col("attributes").getItem(KIND)).isin("LLM", "TOOL")).join(found, ["trace_id", "span_id"])
    return grouped(kept, "task_id", lambda spans: convert_task(spans, prices))


def skipped(docs: DataFrame) -> DataFrame:
    """Rows (kind, spans) of spans that never become events."""
    kind = F.coalesce(F.upper(F.col("attributes").getItem(KIND)), F.lit("(missing)"))
    return otlp.spans(docs).select(kind.alias("kind")).where(~F.col("kind").isin("LLM", "TOOL")).groupBy("kind").agg(F.count("*").alias("spans"))
