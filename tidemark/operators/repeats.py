"""Repeated calls within a task, and the signals that judge them.

Linear tasks (every event follows the one before it) are window functions over one
exchange by task.  Branching tasks, where a repeat looks back along its own ancestors
only, are walked once depth first, task by task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CALL_TYPES, is_call
from .lineage import effective_parents, with_branching

SIGNATURE = ("event_type", "name", "content_hash")
THRESHOLD = 16


def _is_write():
    return (F.col("event_type") != "tool_result") & F.coalesce(F.col("metadata.write"), F.lit(False))


def _is_unknown():
    return (F.col("event_type") == "tool_call") & F.col("metadata.write").isNull()


def annotated(events: DataFrame) -> DataFrame:
    """Events of linear tasks with what a later judgement needs of each.

    next_write and next_unknown are the steps of the next writing call and of the
    next tool call without a write flag; result_hash is the call's own result;
    terminal_outcome is the task's.
    """
    by_task = W.partitionBy("task_id")
    # Backwards, so that "the next one" is a running last value and not a frame per row.
    back = by_task.orderBy(F.col("step_index").desc()).rowsBetween(W.unboundedPreceding, -1)
    follows = F.lead(F.struct("event_type", "content_hash", "metadata.content_basis")).over(by_task.orderBy("step_index"))
    result = F.when(F.col("event_type") == "llm_call", F.col("metadata.response_hash")).when(
        (F.col("event_type") == "tool_call") & (F.col("_after.event_type") == "tool_result") & (F.coalesce(F.col("_after.content_basis"), F.lit("")) != "opaque"),
        F.col("_after.content_hash"),
    )
    real = ~F.coalesce(F.col("metadata.synthesized_cost_only"), F.lit(False))
    last = F.max(F.when(real, F.struct("step_index", "outcome"))).over(by_task)
    return (
        events.withColumn("_after", follows)
        .withColumn("result_hash", result)
        .withColumn("next_write", F.last(F.when(_is_write(), F.col("step_index")), ignorenulls=True).over(back))
        .withColumn("next_unknown", F.last(F.when(_is_unknown(), F.col("step_index")), ignorenulls=True).over(back))
        .withColumn("terminal_outcome", last["outcome"])
        .drop("_after")
    )


def linear_repeats(events: DataFrame) -> DataFrame:
    """Pairs of a call and the nearest earlier call of equal signature, for linear tasks.

    One row per repeat: its own columns, the original's step and result, and the steps
    of the first write and the first unflagged tool call between them (null if none).
    """
    held = annotated(events).where(is_call())
    order = W.partitionBy("task_id", *SIGNATURE).orderBy("step_index")
    earlier = F.lag(F.struct("step_index", "result_hash", "next_write", "next_unknown")).over(order)
    pairs = held.withColumn("o", earlier).where("o is not null")
    between = lambda c: F.when(F.col(c) < F.col("step_index"), F.col(c))
    return pairs.select(
        "task_id",
        F.col("o.step_index").alias("original_step"),
        F.col("step_index").alias("repeat_step"),
        *SIGNATURE,
        "model",
        "workflow",
        "cost_usd",
        "tokens_in",
        "tokens_out",
        F.col("o.result_hash").alias("original_result"),
        F.col("result_hash").alias("repeat_result"),
        between("o.next_write").alias("write_step"),
        between("o.next_unknown").alias("unknown_step"),
        "terminal_outcome",
    )


def _writes(row: dict) -> bool:
    return row["event_type"] != "tool_result" and bool(row["metadata"]["write"])


def _unflagged(row: dict) -> bool:
    return row["event_type"] == "tool_call" and row["metadata"]["write"] is None


def _distance(row: dict, before: dict, threshold: int | None) -> int | None:
    """0 for equal calls if no threshold is given; with one the distance of different calls that are near enough."""
    same = before["content_hash"] == row["content_hash"]
    if threshold is None:
        return 0 if same else None
    mark, other = row["metadata"]["similarity_fingerprint"], before["metadata"]["similarity_fingerprint"]
    if same or mark is None or other is None:
        return None
    far = (int(mark, 16) ^ int(other, 16)).bit_count()
    return far if far <= threshold else None


def _line_pairs(rows: list[dict], threshold: int | None) -> Iterator[tuple]:
    """(repeat row, original row, step of the first write between them, of the first unflagged tool call, distance) of a branching task.

    Without a threshold a call's original is its nearest ancestor of equal signature; with
    one it is the nearest of equal type and name, for rows whose ``exact`` flag is not set.
    The tree is walked once, depth first, with the line of ancestors and, for each
    signature, their places in it; what hangs on a cycle of parents looks back for itself.
    """
    key = (lambda r: (r["event_type"], r["name"], r["content_hash"])) if threshold is None else (lambda r: (r["event_type"], r["name"]))
    asks = lambda r: r["event_type"] in CALL_TYPES and not (threshold is not None and r["exact"])
    children: dict[int | None, list[dict]] = {}
    for r in rows:
        children.setdefault(r["eff_parent"], []).append(r)
    line: list[dict] = []
    places: dict[tuple, list[int]] = {}
    writes: list[int] = []
    unflagged: list[int] = []
    done: set[int] = set()
    todo: list[tuple[dict, bool]] = [(r, True) for r in children.get(None, ())]
    while todo:
        row, entering = todo.pop()
        at = len(line)
        if not entering:
            line.pop()
            for held in (writes, unflagged, places.get(key(row), [])):
                if held and held[-1] == at - 1:
                    held.pop()
            continue
        done.add(row["step_index"])
        own = places.get(key(row))
        if own and asks(row) and (far := _distance(row, line[own[-1]], threshold)) is not None:
            first = [line[held[i]]["step_index"] if (i := bisect_right(held, own[-1])) < len(held) else None for held in (writes, unflagged)]
            yield row, line[own[-1]], *first, far
        line.append(row)
        for held, test in ((writes, _writes(row)), (unflagged, _unflagged(row)), (places.setdefault(key(row), []), row["event_type"] in CALL_TYPES)):
            if test:
                held.append(at)
        todo.append((row, False))
        todo += [(r, True) for r in children.get(row["step_index"], ())]

    by_step = {r["step_index"]: r for r in rows}
    for row in (r for r in rows if r["step_index"] not in done and asks(r)):
        path, seen, at = [], {row["step_index"]}, row["eff_parent"]
        while at is not None and at not in seen and key(by_step[at]) != key(row):
            seen.add(at)
            path.append(by_step[at])
            at = by_step[at]["eff_parent"]
        if at is not None and at not in seen and (far := _distance(row, by_step[at], threshold)) is not None:
            yield row, by_step[at], *[next((p["step_index"] for p in reversed(path) if test(p)), None) for test in (_writes, _unflagged)], far


_PAIR = (
    "task_id string, original_step long, repeat_step long, event_type string, name string, content_hash string, model string, workflow string, cost_usd double, "
    "tokens_in long, tokens_out long, original_result string, repeat_result string, write_step long, unknown_step long, terminal_outcome string"
)
_NAMES = [c.split()[0] for c in _PAIR.split(", ")]


def _result_of(row: dict, children: dict[int, list[dict]]) -> str | None:
    if row["event_type"] == "llm_call":
        return row["metadata"]["response_hash"]
    for child in children.get(row["step_index"], ()):
        if child["event_type"] == "tool_result":
            return None if child["metadata"]["content_basis"] == "opaque" else child["content_hash"]
    return None


def _branching_task(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["step_index"])
    children: dict[int, list[dict]] = {}
    for r in rows:
        children.setdefault(r["eff_parent"], []).append(r)
    real = [r for r in rows if not r["metadata"]["synthesized_cost_only"]]
    outcome = real[-1]["outcome"] if real else None
    out = []
    for row, before, write, unknown, _ in _line_pairs(rows, None):
        own = [row[c] for c in ("event_type", "name", "content_hash", "model", "workflow", "cost_usd", "tokens_in", "tokens_out")]
        out.append((row["task_id"], before["step_index"], row["step_index"], *own, _result_of(before, children), _result_of(row, children), write, unknown, outcome))
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in _PAIR.split(", ")]
    columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def placed_events(events: DataFrame) -> DataFrame:
    """Events with their effective parents, and whether their task branches."""
    return with_branching(effective_parents(events))


def exact_repeats(events: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Exact repeats of all tasks, linear and branching; placed: the events as placed_events gives them."""
    placed = placed_events(events) if placed is None else placed
    branching = placed.where("branching").drop("prev_step", "branching").groupBy("task_id").applyInArrow(_branching_task, _PAIR)
    return linear_repeats(placed.where("not branching")).unionByName(branching)


def fingerprint_bits(column: str) -> F.Column:
    """A 16-digit hexadecimal fingerprint as 64 bits."""
    return F.conv(F.col(column), 16, -10).cast("long")


def linear_near_repeats(events: DataFrame, exact: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Near repeats of linear tasks: the nearest earlier call of equal type and name, if it isn't equal and near enough.

    Calls that are exact repeats already are no candidates, but stay where others look back.
    """
    order = W.partitionBy("task_id", "event_type", "name").orderBy("step_index")
    calls = events.where(is_call()).withColumn("o", F.lag(F.struct("step_index", "content_hash", "metadata.similarity_fingerprint")).over(order))
    far = F.bit_count(fingerprint_bits("metadata.similarity_fingerprint").bitwiseXOR(fingerprint_bits("o.similarity_fingerprint")))
    pairs = calls.where("o.content_hash <> content_hash").withColumn("distance", far.cast("int")).where(F.col("distance") <= threshold)
    claimed = exact.select("task_id", F.col("repeat_step").alias("step_index"))
    pairs = pairs.join(claimed, ["task_id", "step_index"], "left_anti")
    return pairs.select("task_id", F.col("o.step_index").alias("original_step"), F.col("step_index").alias("repeat_step"), *SIGNATURE, "model", "workflow", "cost_usd", "tokens_in", "tokens_out", "distance")


_NEAR = "task_id string, original_step long, repeat_step long, event_type string, name string, content_hash string, model string, workflow string, cost_usd double, tokens_in long, tokens_out long, distance int"


def near_repeats(events: DataFrame, exact: DataFrame, threshold: int = THRESHOLD, placed: DataFrame | None = None) -> DataFrame:
    """Near repeats of all tasks; placed: the events as placed_events gives them."""
    placed = placed_events(events) if placed is None else placed

    def task(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["step_index"])
        own = ("event_type", "name", "content_hash", "model", "workflow", "cost_usd", "tokens_in", "tokens_out")
        out = [(r["task_id"], o["step_index"], r["step_index"], *[r[c] for c in own], far) for r, o, _, _, far in _line_pairs(rows, threshold)]
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
        types = [kinds[c.split()[1]] for c in _NEAR.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _NEAR.split(", ")])

    claimed = exact.select("task_id", F.col("repeat_step").alias("step_index"), F.lit(True).alias("exact"))
    branching = placed.where("branching").drop("prev_step", "branching").join(claimed, ["task_id", "step_index"], "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    return linear_near_repeats(placed.where("not branching"), exact, threshold).unionByName(branching.groupBy("task_id").applyInArrow(task, _NEAR))
