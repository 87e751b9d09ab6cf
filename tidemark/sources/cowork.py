"""Cowork's log records: requests and tool results become events of their session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import otlp
from .convert import as_json, at_nanos, at_text, event, grouped, hashed, number, opaque, whole

NAME = "cowork"
# The documented event names, and the text that stands for withheld content.
EVENTS = ("user_prompt", "assistant_response", "tool_result", "api_request", "api_error", "tool_decision")
REDACTED = "<REDACTED>"


SIGNALS = (("resource service.name=cowork", lambda r: r.resource.getItem("service.name") == NAME),)


def order_of(log: dict) -> tuple:
    """By sequence, records without one last, then by time as text and as read."""
    sequence = log["attributes"].get("event.sequence")
    return (int(sequence) if sequence is not None else 1 << 62, log["attributes"].get("event.timestamp") or "", str(log["ordinal"]))


def truth(value: str | None) -> str | None:
    return {"true": "ok", "false": "error"}.get((value or "").lower())


def tool_name(a: dict) -> str | None:
    """A tool of a server is called by both names."""
    name, parameters = a.get("tool_name"), as_json(a.get("tool_parameters"))
    if isinstance(parameters, dict) and parameters.get("mcp_server_name") and not (name or "").startswith("mcp__"):
        return f"mcp__{parameters['mcp_server_name']}__{parameters.get('mcp_tool_name', name)}"
    return name


def convert_session(logs: list[dict]) -> list[dict]:
    logs = sorted(logs, key=order_of)
    said = lambda a, key: a.get(key) not in (None, "", REDACTED)
    prompts: dict[str, str] = {}
    responses: dict[str, str] = {}
    for log in logs:
        a = log["attributes"]
        if a.get("event.name") == "user_prompt" and a.get("prompt.id") and said(a, "prompt"):
            prompts.setdefault(a["prompt.id"], a["prompt"])
        elif a.get("event.name") == "assistant_response" and a.get("request_id") and said(a, "response"):
            responses[a["request_id"]] = a["response"]
    out: list[dict] = []
    claimed: set[str] = set()
    for log in logs:
        a, step = log["attributes"], len(out)
        name, task = a.get("event.name"), a["session.id"]
        ts = at_text(a.get("event.timestamp")) or at_nanos(log["at"])
        unique = lambda salt, a=a, log=log: opaque(salt, a.get("event.sequence"), a.get("event.timestamp"), log["ordinal"])
        if name in ("api_request", "api_error"):
            prompt_id = a.get("prompt.id")
            prompt = prompts.get(prompt_id) if prompt_id and prompt_id not in claimed else None
            claimed.add(prompt_id or "")
            response = responses.get(a.get("request_id") or "")
            meta = {"content_basis": "prompt" if prompt else "opaque", "response_hash": None if response is None else hashed(response)}
            given = a.get("input_tokens")
            tokens = None if given is None else sum(whole(a.get(k)) or 0 for k in ("input_tokens", "cache_read_tokens", "cache_creation_tokens"))
            out.append(event(task, step, "llm_call", a.get("model"), hashed(prompt) if prompt else unique("llm"), meta=meta, ts=ts, model=a.get("model"), outcome="ok" if name == "api_request" else "error", tokens_in=tokens, tokens_out=whole(a.get("output_tokens")), cost_usd=number(a.get("cost_usd"))))
        elif name == "tool_result":
            given = a.get("tool_input")
            out.append(event(task, step, "tool_call", tool_name(a), hashed(given, True) if given else unique("tool"), meta={"content_basis": "tool_input" if given else "opaque"}, ts=ts, outcome=truth(a.get("success"))))
        elif name == "tool_decision" and a.get("decision") == "reject":
            out.append(event(task, step, "tool_call", a.get("tool_name"), unique("tool-rejected"), meta={"content_basis": "opaque"}, ts=ts, outcome="error"))
    return out


def convert(docs: DataFrame) -> DataFrame:
    """Events of all log documents; records without a session are left out."""
    logs = otlp.logs(docs).withColumn("session", F.col("attributes").getItem("session.id")).where("session <> ''")
    return grouped(logs, "session", convert_session)
