"""Verdicts on small hand-made traces, branching tasks against a literal walk, ingest and reports."""

import json
import random

import pytest

from tidemark.operators.repeats import exact_repeats, near_repeats
from tidemark.operators.task_graph import components, continuation_hops, task_edges
from tidemark.operators.verdicts import classified
from tidemark.plans.waste import WasteAnalysis
from tidemark.registry import Registry
from tidemark.report.render import fraction, headline, legend, number_word, relabelled, short_label, shown_segments, to_html, to_json, to_text
from tidemark.sources.jsonl import BadRows, read_events, write_events


def row(task, step, kind, name="n", content="h", **known):
    return {"task_id": task, "step_index": step, "event_type": kind, "name": name, "content_hash": content} | known


@pytest.fixture
def load(spark, tmp_path):
    def load(rows, lenient=False):
        path = tmp_path / "events.jsonl"
        path.write_text("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
        return read_events(spark, str(path), lenient)

    return load


ONE_EACH = [
    row("waste", 0, "tool_call"), row("waste", 1, "tool_result", content="r"), row("waste", 2, "tool_call", cost_usd=0.5), row("waste", 3, "tool_result", content="r", outcome="error"),
    row("changed", 0, "tool_call"), row("changed", 1, "tool_result", content="r"), row("changed", 2, "tool_call"), row("changed", 3, "tool_result", content="s"),
    row("wrote", 0, "llm_call", metadata={"response_hash": "a"}), row("wrote", 1, "tool_call", name="edit", content="e", metadata={"write": True}), row("wrote", 2, "llm_call", metadata={"response_hash": "a"}),
    row("success", 0, "tool_call"), row("success", 1, "tool_call", name="other", content="o"), row("success", 2, "tool_call"), row("success", 3, "llm_call", name="m", content="z", outcome="ok"),
    row("unknown", 0, "tool_call"), row("unknown", 1, "tool_call"),
    row("truthy", 0, "llm_call", metadata={"response_hash": "a"}), row("truthy", 1, "tool_call", name="edit", content="e", metadata={"write": 1}), row("truthy", 2, "llm_call", metadata={"response_hash": "a"}),
]


def test_each_verdict(load):
    found = {r.task_id: (r.verdict, r.reason) for r in classified(exact_repeats(load(ONE_EACH).events)).collect()}
    assert {t: v for t, (v, _) in found.items()} == {"waste": "confirmed_waste", "changed": "likely_legitimate", "wrote": "likely_legitimate", "success": "likely_legitimate", "unknown": "unclassified", "truthy": "unclassified"}
    assert found["waste"][1] == "result identical; no intervening write; task terminated in failure"
    assert found["wrote"][1] == "write intervened at step 1"
    assert found["truthy"][1].startswith("no legitimate-use signal fired, but write status not recorded")


def literal(rows, threshold=None):
    """Repeats by walking every call's ancestors."""
    tasks: dict = {}
    for r in rows:
        tasks.setdefault(r["task_id"], []).append(r)
    out = set()
    for task, own in tasks.items():
        own = sorted(own, key=lambda r: r["step_index"])
        steps = {r["step_index"]: r for r in own}
        up = {}
        for i, r in enumerate(own):
            parent = r.get("parent_id")
            up[r["step_index"]] = parent if parent in steps else own[i - 1]["step_index"] if i else None
        for r in own:
            if r["event_type"] == "tool_result":
                continue
            seen, at, path = {r["step_index"]}, up[r["step_index"]], []
            while at is not None and at not in seen:
                seen.add(at)
                b = steps[at]
                if (b["event_type"], b["name"], b["content_hash"]) == (r["event_type"], r["name"], r["content_hash"]):
                    acts = [p for p in path[::-1] if p["event_type"] != "tool_result"]
                    flag = lambda p: p.get("metadata", {}).get("write")
                    write = next((p["step_index"] for p in acts if flag(p) is True), None)
                    unknown = next((p["step_index"] for p in acts if flag(p) is None and p["event_type"] == "tool_call"), None)
                    out.add((task, b["step_index"], r["step_index"], write is not None, unknown is not None))
                    break
                path.append(b)
                at = up[at]
    return out


def test_branching_tasks_against_a_literal_walk(load):
    rng = random.Random(11)
    rows = []
    for t in range(40):
        for s in range(rng.randint(1, 15)):
            meta = rng.choice([{}, {"write": True}, {"write": False}])
            parent = rng.choice([None, None, rng.randint(0, 16)])
            rows.append(row(f"t{t}", s, rng.choice(["llm_call", "tool_call", "tool_result"]), rng.choice("ab"), rng.choice("xy"), metadata=meta, parent_id=parent))
    got = {(r.task_id, r.original_step, r.repeat_step, r.write_step is not None, r.unknown_step is not None) for r in exact_repeats(load(rows).events).collect()}
    assert got == literal(rows)


def test_near_repeats_stop_at_the_nearest(load):
    mark = lambda bits: {"similarity_fingerprint": f"{bits:016x}"}
    rows = [row("t", 0, "llm_call", content="a", metadata=mark(0)), row("t", 1, "llm_call", content="b", metadata=mark((1 << 40) - 1)), row("t", 2, "llm_call", content="c", metadata=mark(3))]
    rows += [row("u", 0, "llm_call", content="a", metadata=mark(0)), row("u", 1, "llm_call", content="b", metadata=mark(7), parent_id=0), row("u", 2, "llm_call", content="c", metadata=mark(3), parent_id=0)]
    events = load(rows).events
    got = {(r.task_id, r.original_step, r.repeat_step, r.distance) for r in near_repeats(events, exact_repeats(events)).collect()}
    assert got == {("u", 0, 1, 3), ("u", 0, 2, 2)}


def test_rejects(load):
    bad = [
        "{not json", "[1]", row("t", 0, "nothing"), row("", 0, "llm_call"), row("t", "x", "llm_call"), row("t", 0, "llm_call", outcome="maybe"),
        row("t", 0, "llm_call", tokens_in="many"), row("t", 0, "llm_call", timestamp="yesterday"), row("t", 0, "llm_call", metadata="text"), {"task_id": "t"},
    ]
    good = [row("t", "3", "llm_call"), row("t", 4.7, "llm_call", timestamp=0, outcome="", tokens_in=""), row("t", 0, "llm_call", timestamp="2024-01-01T00:00:00Z", metadata=None)]
    loaded = load(bad + good, lenient=True)
    assert loaded.rejects.count() == len(bad)
    assert sorted(r.step_index for r in loaded.events.collect()) == [0, 3, 4]
    with pytest.raises(BadRows):
        load(bad + good)


def test_mixed_specs_are_refused(load):
    with pytest.raises(BadRows, match="hash_specs"):
        load([row("t", 0, "llm_call", metadata={"hash_spec": "v1"}), row("t", 1, "llm_call", metadata={"hash_spec": "v2"})])


def test_events_survive_writing(spark, load, tmp_path):
    events = load(ONE_EACH).events
    write_events(events, str(tmp_path / "out"))
    again = read_events(spark, str(tmp_path / "out")).events
    assert sorted(map(str, again.collect())) == sorted(map(str, events.collect()))


def test_task_graph(spark, load):
    link = lambda t, parent, kind, step=0: row(t, step, "llm_call", content=t + str(step), metadata={"parent_task_id": parent, "parent_task_link_kind": kind})
    rows = [link("b", "a", "continuation"), link("c", "b", "continuation"), link("d", "b", "continuation"), link("x", "y", "continuation"), link("y", "x", "continuation"), link("s", "a", "spawn"), row("a", 0, "llm_call"), link("q", "a", "spawn"), link("q", "z", "spawn", 1), link("g", "ghost", "spawn")]
    edges = task_edges(load(rows).events)
    assert {r.task_id: r.parent_task_id for r in edges.collect()}["q"] is None
    found = {r.task_id: r.component for r in components(edges).collect()}
    assert {t for t in found if found[t] == found["a"]} == {"a", "b", "c", "d", "s"}
    assert found["x"] == found["y"] and found["g"] == found["ghost"] and found["q"] == "q"
    hops = {(r.tip, r.successor, r.predecessor) for r in continuation_hops(edges).collect()}
    assert hops == {("c", "c", "b"), ("c", "b", "a"), ("d", "d", "b"), ("d", "b", "a")}


def test_long_chain_of_tasks(load):
    rows = [row(f"t{i:03}", 0, "llm_call", metadata={"parent_task_id": f"t{i - 1:03}"} if i else {}) for i in range(150)]
    assert {r.component for r in components(task_edges(load(rows).events)).collect()} == {"t000"}


def test_reports(load):
    analysis = WasteAnalysis().run(load([*ONE_EACH, row("<b>", 0, "tool_call", name="<script>", cost_usd=None), row("billed", 0, "llm_call", cost_usd=0.25, metadata={"synthesized_cost_only": True}), *[row(t, 0, "llm_call", content="same", timestamp=i) for i, t in enumerate(("one", "two"))]]).events)
    report = json.loads(to_json(analysis))
    assert {b["key"]: b["pairs"] for b in report["buckets"]}["confirmed_waste"] == 1
    assert report["verdicts_reached"]["text"] == "4/6 (67%)"
    recurring = report["pair_notes"]["recurring_pairs"]
    assert report["headline"] == headline(report) and report["total_candidates"] == 6 + recurring and recurring
    assert any("no claim of waste" in n for n in report["notes"]) and not any("weaker" in n for n in report["notes"])
    text = to_text(analysis)
    assert "Confirmed waste: 1 pair(s), $0.5000" in text and "A = waste" in text and "task=A step=2" in text and "task=waste" not in text
    assert "Billed without a trace, 1 event(s), $0.2500" in text and "Exact repeats:" in text
    page = to_html(analysis)
    assert "<script" not in page and "&lt;script&gt;" in page
    assert page.count('class="row"') == 6 and 'id="confirmed_waste"' in page and 'class="tabs"' in page and "repeat pairs" in page


def test_report_of_nothing(load, spark):
    empty = load([row("t", 0, "llm_call")]).events.where("false")
    analysis = WasteAnalysis().run(empty)
    assert to_text(analysis).startswith("No repeated calls found.") and "No repeated calls found." in to_html(analysis)


def test_report_texts():
    assert [short_label(i) for i in (0, 25, 26, 27)] == ["A", "Z", "AA", "AB"]
    assert fraction(1, 4) == "1/4" and fraction(3, 4 + 1) == "3/5 (60%)"
    assert legend(["task=a b step=1", "task=c x", "task=a b y"], ["a b", "c"]) == {"a b": "A", "c": "B"}
    assert relabelled("to task=ab step=1 task=a", {"a": "A", "ab": "B"}) == "to task=B step=1 task=A"
    assert [number_word(n) for n in (0, 20, 21, 1000)] == ["zero", "twenty", "21", "1,000"]
    buckets = lambda *n: {"total_candidates": sum(n), "buckets": [{"pairs": n[0], "group": "Exact repeats"}, {"pairs": n[1], "group": "Similar or related"}]}
    assert headline(buckets(0, 0)) == "No repeated calls found."
    assert headline(buckets(1, 0)) == "One repeat pair. One was exact repeats; zero were similar or related."
    assert headline(buckets(8, 30)) == "38 repeat pairs. Eight were exact repeats; 30 were similar or related."


def test_many_segments_are_summed(spark):
    rows = [("unclassified", "model", f"m{i:02}", i + 1, 0.5, 0, 1, 2) for i in range(30)] + [("unclassified", "all", "", 465, 15.0, 0, 30, 60)]
    found = {r.segment: (r.pairs, r.cost_usd) for r in shown_segments(spark.createDataFrame(rows, "bucket string, level string, segment string, pairs long, cost_usd double, unpriced long, tokens_in long, tokens_out long")).collect()}
    assert len(found) == 21 and found["m29"] == (30, 0.5) and found["(others)"] == (sum(range(1, 11)), 5.0)


def test_drift_command(spark, tmp_path, monkeypatch, capsys):
    from tidemark import cli

    link = {"parent_task_id": "a", "parent_task_link_kind": "continuation"}
    rows = [row("a", 0, "llm_call"), row("a", 1, "tool_call"), row("b", 0, "llm_call", metadata=link), row("b", 1, "llm_call", content="z", metadata=link)]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["drift", str(tmp_path / "e.jsonl"), "--format", "json"]) == 0
    (hint,) = json.loads(capsys.readouterr().out)
    assert (hint["predecessor"], hint["successor"]) == ("a", "b")
    assert cli.main(["drift", str(tmp_path / "e.jsonl")]) == 0
    assert "a -> b: shape distance" in capsys.readouterr().out


def test_registry():
    found = Registry("analyses", {"one": 1})
    found.add("two", 2)
    with pytest.raises(ValueError):
        found.add("one", 3)
    with pytest.raises(KeyError):
        found.get("three")


def test_chain_of_many_hops(spark):
    """12,000 hops take a few rounds; a chain that runs into a cycle ends there."""
    from pyspark.sql import functions as F

    edges = spark.range(1, 12_001).select(F.col("id").cast("string").alias("task_id"), (F.col("id") - 1).cast("string").alias("parent_task_id"), F.lit("continuation").alias("link_kind"))
    rows = continuation_hops(edges).agg(F.count("*").alias("n"), F.max("hop").alias("last"), F.countDistinct("tip").alias("tips")).head()
    assert tuple(rows) == (12_000, 11_999, 1)
    loop = spark.createDataFrame([("t", "a", "continuation"), ("a", "b", "continuation"), ("b", "c", "continuation"), ("c", "a", "continuation")], "task_id string, parent_task_id string, link_kind string")
    assert sorted((r.hop, r.successor, r.predecessor) for r in continuation_hops(loop).collect()) == [(0, "t", "a"), (1, "a", "b"), (2, "b", "c"), (3, "c", "a")]


def test_tips_are_ranges_of_one_tour(spark):
    """Hops with ranges of tips against chains followed one by one; tips on one trunk make as many rows as hops."""
    from pyspark.sql import functions as F

    from tidemark.operators.task_graph import continuation_links, continuation_tips

    rng = random.Random(6)
    parent = {f"n{i:03d}": f"n{rng.randrange(max(0, i - 9), i):03d}" for i in range(1, 80) if i % 40}
    rows = [(t, p, "continuation") for t, p in parent.items()] + [("s", "n000", "spawn"), ("u", None, None)]
    edges = spark.createDataFrame(rows, "task_id string, parent_task_id string, link_kind string")
    chains = {}
    for tip in set(parent) - set(parent.values()):
        at = tip
        while at in parent:
            chains.setdefault((at, parent[at]), set()).add(tip)
            at = parent[at]
    for parts in (5,):
        found = continuation_tips(edges, parts).collect()
        assert {(r.successor, r.predecessor): r.last_tip - r.first_tip + 1 for r in found} == {k: len(v) for k, v in chains.items()}
        number = {r.successor: r.first_tip for r in found if r.first_tip == r.last_tip and r.successor not in parent.values()}
        root = {r.successor: r.root for r in found}
        for r in found:
            assert {t for t, n in number.items() if root[t] == r.root and r.first_tip <= n <= r.last_tip} == chains[r.successor, r.predecessor]
    n = 120
    trunk = spark.range(1, n + 1).select(F.format_string("a%d", "id").alias("task_id"), F.format_string("a%d", F.col("id") - 1).alias("parent_task_id"))
    tips = spark.range(n).select(F.format_string("t%d", "id").alias("task_id"), F.lit(f"a{n}").alias("parent_task_id"))
    both = trunk.unionByName(tips).withColumn("link_kind", F.lit("continuation"))
    row = continuation_tips(both).agg(F.count("*").alias("n"), F.max("depth"), F.min("last_tip"), F.max("last_tip")).head()
    assert tuple(row) == (2 * n, n + 1, 1, n)
    loop = spark.createDataFrame([("t", "a", "continuation"), ("a", "b", "continuation"), ("b", "c", "continuation"), ("c", "a", "continuation"), ("x", "y", "continuation"), ("y", "x", "continuation"), ("q", "r", "continuation")], "task_id string, parent_task_id string, link_kind string")
    assert {(r.successor, r.predecessor, r.root, r.depth) for r in continuation_links(loop).collect()} == {("t", "a", None, None), ("a", "b", None, None), ("b", "c", None, None), ("c", "a", None, None), ("q", "r", "r", 1)}


def test_exact_across_hours(spark):
    """Calls of one signature over many hours, against a walk back in time."""
    from tidemark.operators.cross_task import exact_across

    rng = random.Random(4)
    rows = [{"task_id": rng.choice("abc") if i % 7 else "a", "step_index": i, "event_type": "llm_call", "name": "n", "content_hash": rng.choice("xy"), "ts": i * rng.choice([0, 700, 1500]) + (i > 60) * 10**6} for i in range(120)]
    calls = spark.createDataFrame(rows).selectExpr("*", "cast(null as string) model", "cast(null as string) workflow", "cast(null as double) cost_usd", "cast(null as long) tokens_in", "cast(null as long) tokens_out").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["F"]).timestamp_seconds("ts"))
    want, key = set(), lambda r: (r["ts"], r["task_id"], r["step_index"])
    for r in rows:
        before = [b for b in rows if b["content_hash"] == r["content_hash"] and key(b) < key(r) and b["task_id"] != r["task_id"]]
        if before:
            best = max(before, key=key)
            want.add((r["task_id"], r["step_index"], best["task_id"], best["step_index"]))
    got = {(r.task_id, r.repeat_step, r.original_task, r.original_step) for r in exact_across(calls).collect()}
    assert got == want


def test_deep_branching_task(load):
    """A branching task of many calls is walked once."""
    import time

    rows = [row("t", s, "tool_call", content=f"c{s}", parent_id=s - 1 if s else None, metadata={"write": False}) for s in range(6000)]
    rows += [row("t", 6000 + s, "tool_call", content=f"c{s}", parent_id=5999 if s == 0 else 2000) for s in range(1000)]
    events = load(rows).events
    began = time.monotonic()
    found = {(r.original_step, r.repeat_step) for r in exact_repeats(events).collect()}
    assert found == {(s, 6000 + s) for s in range(1000)} and time.monotonic() - began < 60
