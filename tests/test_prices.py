"""Price files, overrides, estimates in the converters, the update command."""

import json
from datetime import datetime, timezone

import pytest

from tests.test_sources import events, folder, span, traces  # noqa: F401
from tidemark import cli
from tidemark.functions import pricing
from tidemark.sources import openinference, opencode, pi
from tidemark.sources.detect import adapt

ENTRIES = {"m1": {"provider": "p", "input": 0.001, "output": 0.01, "cache_read": 0.0001, "cache_write": None}, "m2": {"provider": "p", "input": 1.0, "output": 2.0}}


def write(path, entries, made=None):
    path.write_text(json.dumps({"generated_at": made, "entries": entries}))
    return str(path)


def test_files(tmp_path):
    one = write(tmp_path / "a.json", {**ENTRIES, "broken": {"input": 1}}, "2026-01-01T00:00:00Z")
    two = write(tmp_path / "b.json", {"m2": {"input": 5.0, "output": 6.0}}, "2025-01-01T00:00:00Z")
    (tmp_path / "c.json").write_text("{not json")
    assert pricing.load_prices(one) == (ENTRIES, "2026-01-01T00:00:00Z")
    assert pricing.load_prices(str(tmp_path / "c.json")) == pricing.load_prices(str(tmp_path / "none.json")) == ({}, None)
    entries, made = pricing.load_overlaid(one, two)
    assert entries["m2"]["input"] == 5.0 and entries["m1"] == ENTRIES["m1"] and made == "2026-01-01T00:00:00Z"
    assert pricing.load_overlaid(two, one)[1] == "2026-01-01T00:00:00Z"


def test_cost_of():
    assert pricing.cost_of(ENTRIES, "m1", 10, 2, 5, 7) == pytest.approx(0.01 + 0.02 + 0.0005)
    assert pricing.cost_of(ENTRIES, "m2", None, 3) == 6.0
    assert pricing.cost_of(ENTRIES, "m3", 1, 1) is None and pricing.cost_of(ENTRIES, None, 1, 1) is None
    assert pricing.cost_of(ENTRIES, "m1", None, None, 5) is None


def test_age():
    now = datetime(2026, 3, 1, tzinfo=timezone.utc)
    assert pricing.age_days("2026-02-01T00:00:00Z", now) == 28 and pricing.age_days("no", now) is None and pricing.age_days(None, now) is None
    assert "update" not in pricing.age_note("2026-02-01T00:00:00Z", now) and "update" in pricing.age_note("2026-01-01", now)


def test_openinference(folder):  # noqa: F811
    a = {"openinference.span.kind": "LLM", "input.value": "hi", "llm.model_name": "m1", "llm.token_count.prompt": 100, "llm.token_count.completion": 10, "llm.token_count.prompt_details.cache_read": 50}
    docs = folder(traces(span("s1", "a", 1, a=a), span("s2", "b", 2, a=a | {"llm.cost.total": 0.5}), span("s3", "c", 3, a=a | {"llm.model_name": "other"})))
    got = events(openinference.convert(docs, ENTRIES))
    assert [e["cost_usd"] for e in got] == [pytest.approx(0.1 + 0.1 + 0.005), 0.5, None]
    assert [e["metadata"]["cost_basis"] for e in got] == [pricing.ESTIMATED, None, None]
    assert [e["cost_usd"] for e in events(openinference.convert(docs))] == [None, 0.5, None]


def test_opencode_and_pi(spark):
    message = {"info": {"id": "m", "role": "assistant", "modelID": "m1", "time": {"created": 1, "completed": 2}, "cost": 0, "tokens": {"input": 10, "output": 1, "reasoning": 1, "cache": {"read": 100, "write": 5}}}, "parts": [{"id": "p", "type": "text", "text": "hi"}]}
    text = json.dumps({"info": {"id": "ses1"}, "messages": [message]})
    (e,) = events(opencode.convert(spark.createDataFrame([("ses1", text)], "session_id string, text string"), ENTRIES))
    assert e["cost_usd"] == pytest.approx(0.01 + 0.02 + 0.01) and e["metadata"]["cost_basis"] == pricing.ESTIMATED and e["tokens_in"] == 115
    lines = [{"type": "session", "id": "x", "version": 3}, {"type": "message", "id": "1", "message": {"role": "assistant", "model": "m1", "content": [], "usage": {"input": 10, "output": 2, "cacheRead": 100}}}]
    (e,) = events(pi.convert(spark.createDataFrame([("\n".join(map(json.dumps, lines)), None)], "text string, parent_id string"), ENTRIES))
    assert e["cost_usd"] == pytest.approx(0.01 + 0.02 + 0.01) and e["metadata"]["cost_basis"] == pricing.ESTIMATED


def test_update_and_adapt(spark, tmp_path, monkeypatch, capsys):
    listing = {
        "m1": {"litellm_provider": "openai", "input_cost_per_token": 0.001, "output_cost_per_token": 0.01, "cache_read_input_token_cost": 0.0001, "max_tokens": "many"},
        "azure/m1": {"litellm_provider": "openai", "input_cost_per_token": 1, "output_cost_per_token": 1},
        "other": {"litellm_provider": "someone", "input_cost_per_token": 1, "output_cost_per_token": 1},
        "half": {"litellm_provider": "openai", "input_cost_per_token": 1},
        "sample_spec": "text",
    }
    (tmp_path / "listing.json").write_text(json.dumps(listing))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["update-prices", str(tmp_path / "listing.json"), "--out", str(tmp_path / "prices.json")]) == 0
    entries, made = pricing.load_prices(str(tmp_path / "prices.json"))
    assert entries == {"m1": {"provider": "openai", "input": 0.001, "output": 0.01, "cache_read": 0.0001, "cache_write": None}} and pricing.age_days(made) == 0
    (tmp_path / "in").mkdir()
    a = {"openinference.span.kind": "LLM", "input.value": "hi", "llm.model_name": "m1", "llm.token_count.prompt": 100}
    (tmp_path / "in" / "t.json").write_text(json.dumps(traces(span("s1", "a", 1, a=a))))
    assert cli.main(["adapt", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--prices", str(tmp_path / "prices.json")]) == 0
    assert spark.read.json(str(tmp_path / "out")).head().cost_usd == pytest.approx(0.1)
    assert "0 day(s) old" in capsys.readouterr().err
    assert adapt(spark, str(tmp_path / "in")).head().cost_usd is None
