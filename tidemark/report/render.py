"""Reports of an analysis as JSON, text or a self-contained page.

The analysis' small frames become one dictionary; text and page are two ways to lay the
same parts out.  Tasks get short labels in both, explained in a legend; JSON keeps ids.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pricing import projected_monthly

LABELS = {
    "confirmed_waste": "Confirmed waste",
    "likely_legitimate": "Likely legitimate",
    "unclassified": "Unclassified",
    "near_duplicate": "Near duplicates",
    "cross_task_redundancy": "Cross-task redundancy",
    "recurring_pattern": "Recurring patterns",
}
RULES = {
    "confirmed_waste": "the result was the same, nothing was written in between, and the task failed",
    "likely_legitimate": "the result changed, something was written in between, or the task succeeded",
    "unclassified": "what would decide it wasn't recorded",
    "near_duplicate": "arguments like those of an earlier call, not equal; a weaker signal",
    "cross_task_redundancy": "a call of another task that the source itself links to this one",
    "recurring_pattern": "a call of an unrelated task; no claim of waste",
}
GROUPS = {"Exact repeats": ("confirmed_waste", "likely_legitimate", "unclassified"), "Similar or related": ("near_duplicate", "cross_task_redundancy", "recurring_pattern")}
#: Pairs below which a share is shown without a percentage.
LEAST_FOR_PERCENT = 5
#: Models and workflows shown by bucket; the rest is one line.
MOST_SEGMENTS, OTHERS = 20, "(others)"
_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def fraction(part: int, whole: int) -> str:
    return f"{part}/{whole}" + (f" ({part / whole * 100:.0f}%)" if whole >= LEAST_FOR_PERCENT else "")


def usd(amount: float) -> str:
    return f"${amount:,.4f}" if amount < 1 else f"${amount:,.2f}"


def number_word(n: int) -> str:
    """Up to twenty in letters."""
    return _WORDS[n] if 0 <= n < len(_WORDS) else f"{n:,}"


def short_label(i: int) -> str:
    """0 is A, 25 is Z, 26 is AA."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def shown_segments(slices: DataFrame, most: int = MOST_SEGMENTS) -> DataFrame:
    """The largest models and workflows of each bucket, the others as one row each, so that few rows are collected."""
    order = W.partitionBy("bucket", "level").orderBy(F.col("pairs").desc(), "segment")
    ranked = slices.where("level <> 'all'").withColumn("rank", F.row_number().over(order))
    named = ranked.withColumn("segment", F.when(F.col("rank") <= most, F.col("segment")).otherwise(OTHERS)).withColumn("rank", F.least("rank", F.lit(most + 1)))
    sums = [F.sum(c).alias(c) for c in ("pairs", "cost_usd", "unpriced", "tokens_in", "tokens_out")]
    return named.groupBy("bucket", "level", "segment", "rank").agg(*sums)


def collect(analysis) -> dict:
    """The report's small frames as plain values."""
    rows = lambda df, *order: [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
    found = {r["bucket"]: r for r in rows(analysis.buckets)}
    judged = sum(found[b]["pairs"] for b in ("confirmed_waste", "likely_legitimate"))
    judgeable = judged + found["unclassified"]["pairs"]
    segments = sorted(rows(shown_segments(analysis.slices)), key=lambda r: (list(LABELS).index(r["bucket"]), r["level"], r["rank"]))
    return {
        "analysis": analysis.name,
        "coverage": rows(analysis.coverage)[0],
        "cost_by_basis": sorted(rows(analysis.cost_by_basis), key=lambda r: (-r["usd"], r["basis"])),
        "buckets": [{"key": b, "label": LABELS[b], "group": next(g for g, own in GROUPS.items() if b in own), **{k: v for k, v in found[b].items() if k != "bucket"}} for b in LABELS],
        "segments": [{k: v for k, v in r.items() if k != "rank"} | {"cost_usd": round(r["cost_usd"], 6)} for r in segments],
        "comparability": rows(analysis.comparability)[0],
        "pair_notes": rows(analysis.pair_notes)[0],
        "highlights": rows(analysis.highlights),
        "reasons": rows(analysis.reasons, "bucket", "rank"),
        "unpriced_samples": [r["line"] for r in rows(analysis.unpriced, "task_id", "step_index")],
        "synthesized_samples": [r["line"] for r in rows(analysis.synthesized, "task_id", "step_index")],
        "verdicts_reached": {"judged": judged, "judgeable": judgeable, "text": fraction(judged, judgeable)},
        "total_candidates": sum(r["pairs"] for r in found.values()),
    }


def with_projection(report: dict, calls_per_day: int) -> dict:
    calls = report["coverage"]["call_events"]
    for bucket in report["buckets"]:
        monthly = projected_monthly(bucket["cost_usd"], calls, calls_per_day)
        bucket["cost_per_call"] = round(bucket["cost_usd"] / calls, 8) if calls else None
        bucket["projected_monthly_usd"] = None if monthly is None else round(monthly, 2)
    return report


def headline(report: dict) -> str:
    """How many repeats there are, and how they split over the groups; no bucket is named."""
    total = report["total_candidates"]
    if not total:
        return "No repeated calls found."
    counts = {group: sum(b["pairs"] for b in report["buckets"] if b["group"] == group) for group in GROUPS}
    clauses = [f"{number_word(n)} {'was' if n == 1 else 'were'} {group[0].lower()}{group[1:]}" for group, n in counts.items()]
    return f"{number_word(total).capitalize()} repeat {'pair' if total == 1 else 'pairs'}. {'; '.join(clauses).capitalize()}."


def notes(report: dict) -> list[str]:
    """What the numbers cover, one sentence a signal, silent where there is nothing to say."""
    cov, c, p, out = report["coverage"], report["comparability"], report["pair_notes"], []
    if cov["unpriced_events"]:
        out.append(f"{cov['unpriced_events']} event(s) have no cost and are in no dollar figure; shares are of what is priced.")
    if cov["task_id_confidence"] is not None:
        every = cov["confident_task_ids"] + cov["fallback_task_ids"]
        out.append(f"Task ids: {fraction(cov['confident_task_ids'], every)} events are grouped by a conversation id, the rest by trace, across which repeats aren't seen.")
    if c["events_without"]:
        out.append(f"{fraction(c['tasks_with_pairs'], c['tasks'])} tasks had a repeated call; the other tasks, {usd(c['usd_without'])} in {c['events_without']} event(s), had nothing that repeated.")
    if p["near_pairs"]:
        out.append(f"{fraction(p['tasks_with_near'], p['tasks'])} tasks had a call like an earlier one, {p['near_pairs']} pair(s) in all: a signal of its own, weaker than equal calls.")
    if p["redundancy_pairs"]:
        out.append(f"{p['redundancy_pairs']} pair(s) lie in tasks that the source reports as parts of one workflow.")
    if p["recurring_pairs"]:
        out.append(f"{p['recurring_pairs']} pair(s) lie in tasks without a known relation; that is no claim of waste.")
    return out


def highlight_line(h: dict) -> str:
    return f"{usd(h['cost_usd'])} task={h['task_id']} step={h['repeat_step']} ({h['event_type']}/{h['name']})"


def lines_with_tasks(report: dict) -> list[str]:
    return [*map(highlight_line, report["highlights"]), *(r["line"] for r in report["reasons"]), *report["unpriced_samples"], *report["synthesized_samples"]]


def legend(lines: Iterable[str], tasks: Iterable[str] | None = None) -> dict[str, str]:
    """Short labels of the tasks that the lines name, by first appearance; tasks: their ids, if they may hold spaces."""
    out: dict[str, str] = {}
    known = sorted(tasks or (), key=len, reverse=True)
    pattern = re.compile(r"task=(" + "|".join([*map(re.escape, known), r"\S+"]) + r")(?=\s|$)")
    for line in lines:
        for task in pattern.findall(line):
            out.setdefault(task, short_label(len(out)))
    return out


def relabelled(line: str, labels: dict[str, str]) -> str:
    """A line with short labels for its tasks."""
    known = sorted(labels, key=len, reverse=True)
    return re.sub(r"task=(" + "|".join(map(re.escape, known)) + r")(?=\s|$)", lambda m: f"task={labels[m[1]]}", line) if known else line


def to_json(analysis, max_reasons: int = 20, calls_per_day: int = 1000) -> str:
    report = with_projection(collect(analysis), calls_per_day)
    report["reasons"] = [r for r in report["reasons"] if r["rank"] <= max_reasons]
    report["headline"], report["notes"] = headline(report), notes(report)
    return json.dumps(report, indent=2, sort_keys=True, default=str)


def _prepared(analysis, max_reasons: int, calls_per_day: int) -> tuple[dict, Callable[[str], str], dict[str, str]]:
    """(report, what shortens a line, legend)."""
    report = with_projection(collect(analysis), calls_per_day)
    report["reasons"] = [r for r in report["reasons"] if r["rank"] <= max_reasons]
    labels = legend(lines_with_tasks(report), [h["task_id"] for h in report["highlights"]])
    return report, lambda line: relabelled(line, labels), labels


def _cost(bucket: dict) -> str:
    """A bucket's dollars with how many of its pairs they rest on."""
    priced = bucket["pairs"] - bucket["unpriced"]
    return usd(bucket["cost_usd"]) + (f" ({priced} of {bucket['pairs']} priced)" if bucket["unpriced"] else "")


def to_text(analysis, max_reasons: int = 20, calls_per_day: int = 1000) -> str:
    report, short, labels = _prepared(analysis, max_reasons, calls_per_day)
    cov = report["coverage"]
    lines = [headline(report), "", f"Analysis: {report['analysis']}", f"Events: {cov['total_events']} ({cov['call_events']} calls), priced {fraction(cov['priced_events'], cov['total_events'])}, {usd(cov['priced_usd'])}"]
    lines += [f"  {b['basis']}: {b['events']} event(s), {usd(b['usd'])}" for b in report["cost_by_basis"]]
    lines += [f"Verdicts reached: {report['verdicts_reached']['text']}", *[f"  {n}" for n in notes(report)]]
    if labels:
        lines += ["", "Tasks:", *[f"  {label} = {task}" for task, label in labels.items()]]
    if report["highlights"]:
        lines += ["", "Dearest first:", *[f"  {short(highlight_line(h))}" for h in report["highlights"]]]
    for group in GROUPS:
        lines += ["", f"{group}:"]
        for bucket in (b for b in report["buckets"] if b["group"] == group):
            monthly = bucket["projected_monthly_usd"]
            lines += [f"\n{bucket['label']}: {bucket['pairs']} pair(s), {_cost(bucket)}, tokens {bucket['tokens_in']}/{bucket['tokens_out']}" + (f", {usd(monthly)}/month at {calls_per_day} calls a day" if monthly else ""), f"  Rule: {RULES[bucket['key']]}"]
            lines += [f"  {s['level']} {s['segment']}: {s['pairs']}, {usd(s['cost_usd'])}, tokens {s['tokens_in']}/{s['tokens_out']}" for s in report["segments"] if s["bucket"] == bucket["key"]]
            lines += [f"    {short(r['line'])}" for r in report["reasons"] if r["bucket"] == bucket["key"]]
    for title, own in (("Unpriced", report["unpriced_samples"]), (_untraceable(cov), report["synthesized_samples"])):
        if own:
            lines += ["", f"{title}:", *[f"  {short(x)}" for x in own]]
    return "\n".join(lines) + "\n"


def _untraceable(cov: dict) -> str:
    return f"Billed without a trace, {cov['synthesized_events']} event(s), {usd(cov['synthesized_usd'])}, in no bucket"


_PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{title}</title>
<style>
:root{{--line:#d9d9d9;--soft:#666;--fill:#c9d8ee}}
body{{font:15px/1.5 system-ui,sans-serif;max-width:62rem;margin:2rem auto;padding:0 1rem;color:#222}}
h1{{font-size:1.7rem;line-height:1.25}}section{{margin:2.2rem 0}}p.soft,.soft{{color:var(--soft)}}
table{{border-collapse:collapse;width:100%}}td,th{{padding:.3rem .6rem;text-align:left;border-bottom:1px solid var(--line)}}td.n,th.n{{text-align:right;font-variant-numeric:tabular-nums}}
code{{overflow-wrap:anywhere}}ul{{padding-left:1.2rem}}
.cells{{display:grid;grid-template-columns:repeat(3,1fr);gap:1rem}}.cells div{{border:1px solid var(--line);border-radius:6px;padding:.8rem}}.cells b{{display:block;font-size:1.4rem}}
.row{{display:grid;grid-template-columns:16rem 1fr 12rem;gap:1rem;align-items:center;color:inherit;text-decoration:none;padding:.3rem 0}}.bar{{display:block;height:.7rem;background:var(--fill);border-radius:3px}}
.tabs>input{{position:absolute;opacity:0}}.tabs>label{{display:inline-block;padding:.3rem .8rem;border-bottom:2px solid transparent;cursor:pointer;color:var(--soft)}}.tabs>.panel{{display:none}}
.tabs>input:nth-of-type(1):checked~label:nth-of-type(1),.tabs>input:nth-of-type(2):checked~label:nth-of-type(2){{color:inherit;border-color:currentColor}}
.tabs>input:nth-of-type(1):checked~.panel:nth-of-type(1),.tabs>input:nth-of-type(2):checked~.panel:nth-of-type(2){{display:block}}
.tabs>input:focus-visible~label{{outline:1px dotted}}
@media print{{.tabs>.panel,details>*{{display:block}}}}
</style>
<main>{body}</main><footer class="soft"><p>Amounts are US dollars as the events report them; projections are hypothetical.</p></footer></html>"""


def _e(value: object) -> str:
    return html.escape(str(value), quote=True)


def _table(head: tuple[str, ...], rows: Iterable[tuple]) -> str:
    """Numbers, and texts of dollars, to the right."""
    right = lambda v: isinstance(v, (int, float)) or str(v).startswith("$")
    cells = lambda row: "".join(f"<td{' class=n' * right(v)}>{_e(v)}</td>" for v in row)
    return "<table><tr>" + "".join(f"<th>{_e(h)}</th>" for h in head) + "</tr>" + "".join(f"<tr>{cells(r)}</tr>" for r in rows) + "</table>"


def _listed(lines: Iterable[str]) -> str:
    items = "".join(f"<li><code>{_e(x)}</code></li>" for x in lines)
    return f"<ul>{items}</ul>" if items else ""


def _folded(title: str, body: str) -> str:
    return f"<details><summary>{_e(title)}</summary>{body}</details>" if body else ""


def _tabs(key: str, tables: dict[str, str]) -> str:
    """One table as it is; several as tabs without scripts."""
    if len(tables) < 2:
        return "".join(tables.values())
    inputs = "".join(f'<input type="radio" name="{key}" id="{key}-{i}"{" checked" * (not i)}>' for i in range(len(tables)))
    labels = "".join(f'<label for="{key}-{i}">{_e(title)}</label>' for i, title in enumerate(tables))
    return f'<div class="tabs">{inputs}{labels}{"".join(f"""<div class="panel">{t}</div>""" for t in tables.values())}</div>'


def _bars(buckets: list[dict]) -> str:
    """A row a bucket that leads to it: by dollars if there are any, else by pairs."""
    by_cost = any(b["cost_usd"] > 0 for b in buckets)
    size = {b["key"]: b["cost_usd"] if by_cost else b["pairs"] for b in buckets}
    most = max(size.values()) or 1
    shown = lambda b: usd(b["cost_usd"]) + ("" if b["projected_monthly_usd"] is None else f", {usd(b['projected_monthly_usd'])} a month") if by_cost else f"{b['pairs']} pair(s)"
    return "".join(f'<a class="row" href="#{b["key"]}"><span>{_e(b["label"])} <span class="soft">{b["pairs"]}</span></span><span class="bar" style="width:{100 * size[b["key"]] / most:.1f}%"></span><span>{_e(shown(b))}</span></a>' for b in buckets)


def to_html(analysis, max_reasons: int = 20, calls_per_day: int = 1000) -> str:
    """One page without scripts; everything from the trace is escaped."""
    report, short, labels = _prepared(analysis, max_reasons, calls_per_day)
    cov, title = report["coverage"], headline(report)
    cells = {"repeat pairs": report["total_candidates"], "verdicts reached": report["verdicts_reached"]["text"], "of priced spend": usd(cov["priced_usd"])}
    parts = [
        f"<section><p class='soft'>Event analysis: {_e(report['analysis'])}</p><h1>{_e(title)}</h1></section>",
        "<section class='cells'>" + "".join(f"<div><b>{_e(v)}</b>{_e(k)}</div>" for k, v in cells.items()) + "</section>",
        f"<section><p>{_e(cov['priced_events'])} of {_e(cov['total_events'])} events carry a cost. Projections assume {calls_per_day:,} calls a day.</p>" + "".join(f"<p>{_e(n)}</p>" for n in notes(report)) + _folded(f"Tasks ({len(labels)})", _listed(f"{label} = {task}" for task, label in labels.items())) + "</section>",
    ]
    if report["highlights"]:
        parts.append("<section><h2>Dearest first</h2>" + _listed(short(highlight_line(h)) for h in report["highlights"]) + "</section>")
    parts.append("<section><h2>Spend by kind of repeat</h2>" + _bars(report["buckets"]) + "</section>")
    parts.append("<section><h2>Cost by basis</h2>" + _table(("Basis", "Events", "Cost"), [(b["basis"], b["events"], usd(b["usd"])) for b in report["cost_by_basis"]]) + "</section>")
    for group in GROUPS:
        parts.append(f"<h2>{_e(group)}</h2>")
        for b in (b for b in report["buckets"] if b["group"] == group):
            own = {level: [s for s in report["segments"] if s["bucket"] == b["key"] and s["level"] == level] for level in ("model", "workflow")}
            tables = {f"By {level}": _table((level.capitalize(), "Pairs", "Cost", "Tokens in", "Tokens out"), [(s["segment"], s["pairs"], usd(s["cost_usd"]), s["tokens_in"], s["tokens_out"]) for s in rows]) for level, rows in own.items() if rows}
            reasons = _listed(short(r["line"]) for r in report["reasons"] if r["bucket"] == b["key"])
            parts.append(f'<section id="{b["key"]}"><h3>{_e(b["label"])}: {b["pairs"]}</h3><p class="soft">{_e(RULES[b["key"]])}</p><p>{_e(_cost(b))}</p>' + _tabs(f"tab-{b['key']}", tables) + _folded("Cases to check by hand", reasons) + "</section>")
    for name, own in (("Events without a cost", report["unpriced_samples"]), (_untraceable(cov), report["synthesized_samples"])):
        if own:
            parts.append(f"<section><h2>{_e(name)}</h2>" + _folded("Samples", _listed(map(short, own))) + "</section>")
    return _PAGE.format(title=_e(f"Repeated calls: {report['analysis']}"), body="".join(parts))
