"""Converters on small hand-made telemetry."""

import json
import time

import pytest

from tidemark.sources import coding_cli, cowork, openclaw, openclaw_localtrace, openinference, otlp
from tidemark.sources.detect import UnknownSource, adapt, detect

S = 1_000_000_000


def value(v):
    kind = {bool: "boolValue", int: "intValue", float: "doubleValue", str: "stringValue"}[type(v)]
    return {kind: str(v) if kind == "intValue" else v}


def attrs(a):
    return [{"key": k, "value": value(v)} for k, v in (a or {}).items()]


def span(id_, name, start, end=None, parent=None, trace="t1", status=None, events=(), **a):
    out = {"traceId": trace, "spanId": id_, "name": name, "startTimeUnixNano": str(start * S), "attributes": attrs(a.pop("a", None)), "events": [{"name": n, "timeUnixNano": "0", "attributes": attrs(x)} for n, x in events]}
    out |= {"endTimeUnixNano": str(end * S)} if end is not None else {}
    out |= {"parentSpanId": parent} if parent else {}
    return out | ({"status": {"code": status}} if status is not None else {})


def log(at, a):
    return {"timeUnixNano": str(at * S), "attributes": attrs(a)}


def traces(*spans, resource=None):
    return {"resourceSpans": [{"resource": {"attributes": attrs(resource)}, "scopeSpans": [{"spans": list(spans)}]}]}


def logs(*records, resource=None):
    return {"resourceLogs": [{"resource": {"attributes": attrs(resource)}, "scopeLogs": [{"logRecords": list(records)}]}]}


def metrics(name, kind, points, **data):
    rows = [{"asDouble": v, "startTimeUnixNano": str(start * S), "timeUnixNano": str(at * S), "attributes": attrs(a)} for v, start, at, a in points]
    return {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, kind: {"dataPoints": rows, **data}}]}]}]}


@pytest.fixture
def folder(spark, tmp_path):
    def write(*documents):
        for i, d in enumerate(documents):
            (tmp_path / f"{i:02}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=1))
        return otlp.read_documents(spark, str(tmp_path))

    return write


def events(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: (r["task_id"], r["step_index"]))


def test_flatten(folder):
    docs = folder(
        traces(span("s1", "a", 1, 2, status=2, a={"x": 1, "y": True, "z": 0.5, "w": "t"}), resource={"service.name": "svc"}),
        logs(log(5, {"k": "v"})), {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"observedTimeUnixNano": "7"}, {}]}]}]},
        metrics("m", "sum", [(1.5, 1, 2, {"c": "d"})], aggregationTemporality=2, isMonotonic=True), metrics("g", "gauge", [(2.5, 0, 3, {})]), {"other": 1},
    )
    kinds = {r.file[-7:]: (r.is_trace, r.is_log, r.is_metrics) for r in docs.collect()}
    assert kinds["00.json"] == (True, False, False) and kinds["05.json"] == (False, False, False)
    s = otlp.spans(docs).head()
    assert (s.start, s.end, s.outcome, s.attributes, s.resource) == (S, 2 * S, "error", {"x": "1", "y": "true", "z": "0.5", "w": "t"}, {"service.name": "svc"})
    assert sorted(r["at"] for r in otlp.logs(docs).collect()) == [0, 7, 5 * S]
    points = {r.name: r for r in otlp.metric_points(docs).collect()}
    assert (points["m"].value, points["m"].temporality, points["m"].monotonic) == (1.5, "cumulative", True)
    assert points["g"].temporality is None


def test_last_duplicate_attribute_stays(folder):
    twice = {"resourceSpans": [{"scopeSpans": [{"spans": [{**span("s", "a", 1), "attributes": [*attrs({"k": "1"}), *attrs({"k": "2"})]}]}]}]}
    assert otlp.spans(folder(twice)).head().attributes == {"k": "2"}


def test_bad_documents(folder):
    with pytest.raises(Exception, match="not JSON"):
        folder("{broken").collect()
    with pytest.raises(Exception, match="without traceId"):
        otlp.spans(folder(traces({"spanId": "x", "startTimeUnixNano": "1"}))).collect()


def oi(kind, text=None, **more):
    return {openinference.KIND: kind} | ({} if text is None else {"input.value": text}) | more


def test_openinference(folder):
    docs = folder(traces(
        span("root", "agent run", 0, 100, a=oi("AGENT", **{"gen_ai.conversation.id": "conv", "agent.name": "searcher"})),
        span("turn", "turn", 1, 90, "root", a=oi("CHAIN")),
        span("m1", "llm", 2, 5, "turn", status=1, a=oi("LLM", "hello", **{"llm.model_name": "gpt", "llm.token_count.prompt": 10, "llm.cost.total": 0.25})),
        span("t1", "tool", 6, 8, "m1", status=1, a=oi("TOOL", '{"b":1,"a":2}', **{"tool.name": "search", "output.value": "found"})),
        span("t2", "tool", 9, 12, "m1", a=oi("TOOL", '{"q":1}')),
        span("t3", "tool", 10, 11, "m1", a=oi("TOOL", '{"q":2}')),
        span("m2", "outer", 20, 25, "turn", a=oi("LLM", "again")),
        span("m2c", "inner", 21, 24, "m2", a=oi("LLM", **{"gen_ai.usage.input_tokens": 7, "gen_ai.request.model": "donor"})),
        span("x", "lost", 30, 31, trace="t2", a=oi("LLM", "alone")),
        span("e", "empty", 40, 41, a=oi("TOOL")),
    ))
    assert detect(docs)[0] is openinference
    got = events(openinference.convert(docs))
    assert [(e["task_id"], e["step_index"], e["event_type"], e["name"], e["parent_id"]) for e in got] == [
        ("conv", 0, "llm_call", "gpt", None), ("conv", 1, "tool_call", "search", 0), ("conv", 2, "tool_result", "search", 1), ("conv", 3, "tool_call", "tool", 2), ("conv", 4, "tool_call", "tool", 0), ("conv", 5, "llm_call", "donor", None),
        ("t2", 0, "llm_call", "lost", None),
    ]
    assert got[0]["workflow"] == "searcher" and got[0]["cost_usd"] == 0.25 and got[0]["tokens_in"] == 10 and got[0]["outcome"] == "ok"
    assert got[1]["model"] == "gpt" and got[1]["metadata"]["model_basis"] == "preceding_llm_call"
    assert got[5]["tokens_in"] == 7 and got[-1]["metadata"]["task_id_source"] == "trace_id_fallback"
    assert {r.kind: r.spans for r in openinference.skipped(docs).collect()} == {"AGENT": 1, "CHAIN": 1}


def test_cowork(folder):
    base = {"session.id": "s"}
    docs = folder(logs(
        log(1, base | {"event.name": "user_prompt", "event.sequence": 1, "prompt.id": "p", "prompt": "do it"}),
        log(2, base | {"event.name": "api_request", "event.sequence": 2, "prompt.id": "p", "request_id": "r", "model": "m", "input_tokens": 3, "cache_read_tokens": 4, "output_tokens": 5, "cost_usd": 0.5}),
        log(3, base | {"event.name": "assistant_response", "event.sequence": 3, "request_id": "r", "response": "done"}),
        log(4, base | {"event.name": "tool_result", "event.sequence": 4, "tool_name": "t", "tool_input": '{"a":1}', "success": "false", "tool_parameters": '{"mcp_server_name":"srv","mcp_tool_name":"x"}'}),
        log(5, base | {"event.name": "tool_decision", "event.sequence": 5, "decision": "reject", "tool_name": "t"}),
        log(6, base | {"event.name": "tool_decision", "event.sequence": 6, "decision": "accept", "tool_name": "t"}),
        log(7, base | {"event.name": "api_error", "event.sequence": 7, "prompt.id": "p", "model": "m"}),
        log(8, {"event.name": "api_request", "model": "nobody"}),
    ))
    assert detect(docs)[0] is cowork
    got = events(cowork.convert(docs))
    assert [(e["event_type"], e["name"], e["outcome"], e["metadata"]["content_basis"]) for e in got] == [("llm_call", "m", "ok", "prompt"), ("tool_call", "mcp__srv__x", "error", "tool_input"), ("tool_call", "t", "error", "opaque"), ("llm_call", "m", "error", "opaque")]
    assert (got[0]["tokens_in"], got[0]["tokens_out"], got[0]["cost_usd"]) == (7, 5, 0.5) and got[0]["metadata"]["response_hash"]


def test_openclaw(folder):
    call = lambda id_, at, tokens, **a: span(id_, openclaw.CALL, at, at + 1, "h", a={"gen_ai.request.model": "m", "gen_ai.usage.input_tokens": tokens} | a)
    docs = folder(
        traces(span("h", openclaw.HARNESS, 0, 50, a={"openclaw.channel": "chat", "openclaw.harness.id": "bot"}), call("a", 1, 30, **{"gen_ai.input.messages": "[1]", "gen_ai.output.messages": "[2]"}), call("b", 20, 10), span("c", openclaw.TOOL, 3, 4, "a", a={"gen_ai.tool.name": "t", "gen_ai.tool.call.arguments": "{}", "gen_ai.tool.call.result": "{}", "error.type": "x"})),
        metrics(openclaw.COUNTER, "sum", [(0.1, 5, 6, {"openclaw.channel": "chat", "openclaw.model": "m"}), (0.4, 5, 9, {"openclaw.channel": "chat", "openclaw.model": "m"}), (1.0, 15, 30, {"openclaw.channel": "chat", "openclaw.model": "m"})], aggregationTemporality=2),
    )
    assert detect(docs)[0] is openclaw
    got = events(openclaw.convert(docs))
    assert [(e["event_type"], e["parent_id"], e["outcome"], e["workflow"]) for e in got] == [("llm_call", None, "ok", "bot"), ("tool_call", 0, None, "bot"), ("tool_result", 1, "error", "bot"), ("llm_call", None, "ok", "bot")]
    assert [e["cost_usd"] for e in got] == [0.4, None, None, 1.0]
    assert got[0]["metadata"]["cost_basis"] == "apportioned_from_metrics_by_tokens" and got[0]["metadata"]["similarity_fingerprint"]
    assert got[3]["metadata"]["similarity_fingerprint"] is None


def test_openclaw_localtrace(folder):
    own = {"openclaw.sessionId": "s"}
    docs = folder(
        traces(span("r", openclaw_localtrace.RUN, 0, 20, a=own | {"openclaw.agentId": "bot"}), span("a", openclaw_localtrace.CALL, 1, 3, "r", a=own | {"openclaw.model": "m"}), span("b", openclaw_localtrace.CALL, 4, 6, "r", a=own | {"openclaw.model": "m"}), span("x", openclaw_localtrace.CONTENT, 0, 7, "r", a={"gen_ai.input.messages": "[1]", "gen_ai.usage.input_tokens": 5}), span("t", openclaw_localtrace.TOOL, 8, 9, "r", a=own | {"openclaw.toolName": "w", "openclaw.mutatingAction": True, "gen_ai.tool.call.result": "{}"})),
        metrics(openclaw_localtrace.GAUGE, "gauge", [(0.6, 0, 21, own), (9.0, 0, 10, own), (9.0, 0, 22, {})]),
    )
    assert detect(docs)[0] is openclaw_localtrace
    got = events(openclaw_localtrace.convert(docs))
    assert [(e["event_type"], e["metadata"]["content_basis"], e["metadata"]["write"]) for e in got] == [("llm_call", "opaque", None), ("llm_call", "prompt", None), ("tool_call", "opaque", True), ("tool_result", "prompt", None)]
    assert [e["cost_usd"] for e in got] == [0.0, 0.6, None, None] and got[1]["tokens_in"] == 5


def test_pairing_takes_the_last_unclaimed():
    spans = lambda *ends: [{"span_id": f"{i}", "start": 0, "end": e} for i, e in enumerate(ends)]
    got = openclaw_localtrace.pair(spans(1, 3, 5), [{"span_id": "x", "start": 0, "end": 4}, {"span_id": "y", "start": 0, "end": 9}, {"span_id": "z", "start": 0, "end": 0}])
    assert {k: v["span_id"] for k, v in got.items()} == {"1": "x", "2": "y"}


def test_coding_cli(folder):
    base = {"session.id": "s"}
    p = coding_cli.PREFIX
    docs = folder(
        traces(
            span("i", p + "interaction", 0, 50, a=base | {"user_prompt": "fix it"}), span("a", p + "llm_request", 1, 9, "i", a=base | {"model": "m", "request_id": "r1", "input_tokens": 2, "cache_read_tokens": 3, "success": True}),
            span("b", p + "tool", 4, 6, "i", a=base | {"tool_name": "Bash"}, events=[("tool.output", {"content": "ok"})]), span("e", p + "tool.execution", 4, 5, "b", a=base | {"success": False}),
            span("c", p + "llm_request", 7, 8, "i", a=base | {"model": "m"}), span("d", p + "tool", 10, 11, "i", a=base | {"tool_name": "Read", "file_path": "x"}),
        ),
        logs(log(5, base | {"event.name": "tool_result", "event.sequence": 1, "tool_name": "Bash", "tool_input": '{"command":"ls"}'}), log(5, base | {"event.name": "api_request", "request_id": "r1", "cost_usd": 0.5}), log(6, base | {"event.name": "api_request", "request_id": "r2", "cost_usd": 0.25, "model": "t"})),
    )
    assert detect(docs)[0] is coding_cli
    got = events(coding_cli.convert(docs))
    assert [(e["event_type"], e["parent_id"], e["outcome"], e["metadata"]["content_basis"], e["cost_usd"]) for e in got] == [
        ("llm_call", None, "ok", "prompt", 0.5), ("tool_call", 0, None, "tool_input", None), ("tool_result", 1, "error", "prompt", None), ("llm_call", 2, None, "opaque", None), ("tool_call", 3, None, "tool_input", None), ("llm_call", None, None, "log_only_no_span", 0.25),
    ]
    assert got[0]["tokens_in"] == 5 and got[5]["metadata"]["synthesized_cost_only"] and got[1]["model"] == "m"


def test_prompts_by_time(folder):
    base = {"session.id": "s"}
    docs = folder(
        traces(span("a", coding_cli.REQUEST, 12, 13, a=base), span("b", coding_cli.REQUEST, 14, 15, a=base), span("c", coding_cli.REQUEST, 25, 26, a=base)),
        logs(log(10, base | {"event.name": "user_prompt", "event.sequence": 1, "prompt": "one", "event.timestamp": "1970-01-01T00:00:10Z"}), log(20, base | {"event.name": "user_prompt", "event.sequence": 2, "prompt": "two", "event.timestamp": "1970-01-01T00:00:20Z"})),
    )
    assert [e["metadata"]["content_basis"] for e in events(coding_cli.convert(docs))] == ["prompt_windowed", "opaque", "prompt_windowed"]


def test_unknown_source(folder):
    with pytest.raises(UnknownSource):
        detect(folder(traces(span("s", "other", 1))))


def test_adapt_a_folder(spark, folder, tmp_path):
    folder(traces(span("m", "llm", 2, 5, a=oi("LLM", "hello"))))
    assert adapt(spark, str(tmp_path)).count() == 1
    assert adapt(spark, str(tmp_path), "openinference").count() == 1


def test_streaming_repeats(spark, tmp_path):
    from tidemark.streaming.repeats import streaming_repeats

    schema = "task_id string, step_index long, event_type string, name string, content_hash string"
    rows = [("t", 0, "llm_call", "n", "h"), ("t", 1, "tool_result", "n", "h"), ("t", 2, "llm_call", "n", "h"), ("u", 0, "llm_call", "n", "h")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
    query = streaming_repeats(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    deadline = time.monotonic() + 90  # batches without data go on until timeouts are due
    while query.isActive and not spark.table("pairs").count() and time.monotonic() < deadline:
        time.sleep(1)
    query.stop()
    assert [tuple(r)[:3] for r in spark.table("pairs").collect()] == [("t", 0, 2)]


def test_pi(spark, tmp_path):
    from tidemark.sources import pi

    def line(id_, parent, role=None, second=0, **more):
        message = {"message": {"role": role} | more.pop("m", {})} if role else {}
        return {"type": "message" if role else more.pop("type"), "id": id_, "parentId": parent, "timestamp": f"2024-01-01T00:00:{second:02}Z"} | message | more

    entries = [
        line("u", None, "user", 1, m={"content": "hi"}),
        line("a", "u", "assistant", 2, m={"content": [{"type": "toolCall", "id": "c1", "name": "read", "arguments": {"p": 1}}, {"type": "toolCall", "id": "c2", "name": "gone"}], "model": "m", "usage": {"input": 3, "cacheRead": 4, "output": 5, "cost": {"total": 0.5}}}),
        line("r", "a", "toolResult", 3, m={"toolCallId": "c1", "toolName": "read", "content": [{"text": "x"}]}),
        line("b", "r", "assistant", 4, m={"content": [], "model": "m", "stopReason": "error", "usage": {"totalTokens": 9, "input": 9, "cost": {"total": 0}}}),
        line("b2", "a", "assistant", 5, m={"content": [], "model": "m"}),
        line("k", "b", type="compaction", second=6, summary="s", usage={"input": 1, "cost": {"total": 0.25}}),
        line("p", "k", "assistant", 7, m={"stopReason": "pending"}),
    ]
    first = [{"type": "session", "id": "one", "version": 3}, *entries]
    fork = [{"type": "session", "id": "two", "version": 3, "parentSession": str(tmp_path / "a.jsonl"), "timestamp": "2024-01-01T00:00:03Z"}, *entries[:4]]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, first)) + '\n{"partial')
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, fork)))
    (tmp_path / "c.jsonl").write_text('{"type": "other"}\n')
    got = events(pi.convert(pi.read_sessions(spark, str(tmp_path))))
    assert [(e["step_index"], e["event_type"], e["name"], e["parent_id"], e["outcome"], e["cost_usd"]) for e in got if e["task_id"] == "one"] == [
        (0, "llm_call", "m", None, "ok", 0.5), (1, "tool_call", "gone", 0, None, None), (2, "tool_call", "read", 0, None, None), (3, "tool_result", "read", 2, "ok", None),
        (4, "llm_call", "m", 3, "error", None), (5, "llm_call", "m", 0, "ok", None), (6, "llm_call", "pi:compaction", None, None, 0.25),
    ]
    two = [e for e in got if e["task_id"] == "two"]
    assert [e["event_type"] for e in two] == ["tool_result", "llm_call"] and two[0]["metadata"]["parent_task_id"] == "one" and two[0]["metadata"]["parent_task_link_kind"] == "continuation"
    assert got[0]["tokens_in"] == 7 and got[6]["metadata"]["synthesized_cost_only"]


def _opencode():
    tool = lambda id_, status, out, tool="edit": {"id": id_, "type": "tool", "tool": tool, "state": {"status": status, "input": {"f": id_}, "output" if status == "completed" else "error": out, "time": {"start": 5000, "end": 6000}}}
    messages = [
        ({"id": "m1", "role": "user", "time": {"created": 1000}}, [{"id": "p1", "type": "text", "text": "hi"}]),
        ({"id": "m2", "role": "assistant", "modelID": "m", "agent": "build", "time": {"created": 2000, "completed": 9000}}, [
            {"id": "p1", "type": "step-start"}, tool("p2", "completed", "done"), {"id": "p3", "type": "step-finish", "reason": "tool", "cost": 0.5, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4}}}, {"id": "p4", "type": "patch", "files": ["a"]},
            {"id": "p5", "type": "step-start"}, tool("p6", "error", "[redacted:x]"), tool("p7", "running", None), {"id": "p8", "type": "step-finish", "cost": 0, "tokens": {"input": 1}},
        ]),
        ({"id": "m3", "role": "assistant", "modelID": "m", "time": {"created": 9500}, "error": {"name": "E"}}, []),
    ]
    return messages


WANT = [
    ("llm_call", "m", "ok", 0.5, None), ("tool_call", "edit", None, None, True), ("tool_result", "edit", "ok", None, None),
    ("llm_call", "m", "ok", None, None), ("tool_call", "edit", None, None, None), ("tool_result", "edit", "error", None, None), ("tool_call", "edit", None, None, None), ("llm_call", "m", "error", None, None),
]


def test_opencode_exports(spark, tmp_path):
    from tidemark.sources import opencode

    doc = {"info": {"id": "ses_1", "parentID": "ses_0"}, "messages": [{"info": i, "parts": p} for i, p in _opencode()]}
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "c.json").write_text('{"info": {"id": "other"}, "messages": []}')
    got = events(opencode.convert(opencode.read_exports(spark, str(tmp_path))))
    assert [(e["event_type"], e["name"], e["outcome"], e["cost_usd"], e["metadata"]["write"]) for e in got] == WANT
    assert (got[0]["tokens_in"], got[0]["tokens_out"], got[0]["workflow"]) == (5, 5, "build")
    assert [e["metadata"]["content_basis"] for e in got] == ["prompt", "tool_input", "tool_output", "prompt", "tool_input", "opaque", "tool_input", "opaque"]
    assert got[0]["metadata"]["parent_task_link_kind"] == "delegation"
    assert [e["parent_id"] for e in got] == [None, *range(7)]


def test_opencode_database(spark, tmp_path):
    import sqlite3

    from tidemark.sources import opencode

    path = tmp_path / "o.db"
    base = sqlite3.connect(path)
    base.executescript("CREATE TABLE session (id, parent_id, agent, time_created); CREATE TABLE message (id, session_id, time_created, data); CREATE TABLE part (id, message_id, data);")
    base.execute("INSERT INTO session VALUES ('ses_1', NULL, 'build', 1)")
    for info, parts in _opencode():
        base.execute("INSERT INTO message VALUES (?, 'ses_1', ?, ?)", (info["id"], info["time"]["created"], json.dumps(info)))
        base.executemany("INSERT INTO part VALUES (?, ?, ?)", [(p["id"], info["id"], json.dumps(p)) for p in parts])
    base.commit()
    base.close()
    got = events(opencode.convert(opencode.from_tables(**opencode.sqlite_tables(spark, str(path)))))
    assert [(e["event_type"], e["name"], e["outcome"], e["cost_usd"], e["metadata"]["write"]) for e in got] == WANT


def test_opencode_compaction():
    from tidemark.sources.opencode import after_compaction

    m = lambda id_, role, parts=(), **info: {"info": {"id": id_, "role": role} | info, "parts": list(parts)}
    messages = [m("1", "user"), m("2", "assistant"), m("3", "user", [{"type": "compaction", "tail_start_id": "2"}]), m("4", "assistant", summary=True, finish="stop", parentID="3"), m("5", "user")]
    assert [x["info"]["id"] for x in after_compaction(messages)] == ["3", "4", "2", "5"]
    assert [x["info"]["id"] for x in after_compaction(messages[:3])] == ["1", "2", "3"]


def test_adapt_native_sessions(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type": "session", "id": "one"}\n{"type": "message", "message": {"role": "assistant", "model": "m"}}\n')
    assert adapt(spark, str(tmp_path)).head().task_id == "one"
    with pytest.raises(UnknownSource):
        (tmp_path / "empty").mkdir()
        adapt(spark, str(tmp_path / "empty"))
