"""Prefix scans in parts, and what is built on them, against plain loops."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cross_task import exact_across, near_across
from tidemark.operators.scan import PART, in_parts, running_count
from tidemark.schema import EVENT


def test_running_count_over_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "x", "y"]), i, rng.random() < 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, f boolean").repartition(7)
    for parts in (1, 8):
        seen, got = Counter(), {r.i: (r.n, r.m) for r in running_count(running_count(df, ["k"], ["i"], "n", parts=parts), ["k"], ["i"], "m", F.col("f"), parts).collect()}
        on = Counter()
        for k, i, f in rows:
            seen[k] += 1
            on[k] += f
            assert got[i] == (seen[k], on[k])
    sizes = [r["count"] for r in in_parts(df, ["k"], ["i"], 8).groupBy(PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * len(rows) / 8
    assert running_count(df.where("false"), ["k"], ["i"], "n").collect() == []


def calls_of(spark, rows):
    """Calls (task, step, second, content, bits) of one tool."""
    event = lambda t, s, at, h, bits: (t, s, "tool_call", "go", h, None, None, None, datetime.fromtimestamp(at, timezone.utc), None, None, None, None)
    names = [f.name for f in EVENT]
    made = spark.createDataFrame([dict(zip(names, event(*r), strict=False)) for r in rows], EVENT)
    marks = spark.createDataFrame([(t, s, f"{bits:016x}") for t, s, _, _, bits in rows], "task_id string, step_index long, mark string")
    meta = [F.col("mark").alias(n) if n == "similarity_fingerprint" else F.lit(None).cast(EVENT["metadata"].dataType[n].dataType).alias(n) for n in EVENT["metadata"].dataType.fieldNames()]
    return made.join(marks, ["task_id", "step_index"]).withColumn("metadata", F.struct(*meta)).drop("mark")


def test_exact_across_one_busy_second(spark):
    rng = random.Random(2)
    rows = [(f"t{rng.randrange(4)}", i, rng.choice([5, 5, 5, 6]), rng.choice("aab"), 0) for i in range(400)]
    want, last = set(), defaultdict(list)
    for t, s, _, h, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        other = next((x for x in reversed(last[h]) if x[0] != t), None)
        if other:
            want.add((t, s, *other))
        last[h].append((t, s))
    for parts in (1, 9):
        found = exact_across(calls_of(spark, rows), parts)
        assert {(r.task_id, r.repeat_step, r.original_task, r.original_step) for r in found.collect()} == want


@pytest.mark.parametrize("window, block, tasks", [(4, 3, 3), (10, 256, 7), (2, 1, 2)])
def test_bands_look_back_to_the_latest_fit(spark, window, block, tasks):
    rng = random.Random(window)
    rows = [(f"t{rng.randrange(tasks)}", i, i // 5, "h", (rng.randrange(3) << 48) | rng.getrandbits(40)) for i in range(150)]
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    want = set()
    for i, (t, s, _, _, bits) in enumerate(order):
        fits = lambda j: order[j][0] != t and (bits ^ order[j][4]).bit_count() <= 14  # noqa: B023, E731
        near = [j for j in range(max(0, i - window), i) if fits(j)] or [j for j in range(max(0, i - window)) if fits(j) and any((bits ^ order[j][4]) >> 16 * b & 65535 == 0 for b in range(4))]
        if near:
            j = near[-1]
            want.add((t, s, order[j][0], order[j][1], (bits ^ order[j][4]).bit_count()))
    found = near_across(calls_of(spark, rows), 14, window, block, parts=5)
    assert {(r.task_id, r.repeat_step, r.original_task, r.original_step, r.distance) for r in found.collect()} == want and want


def test_a_band_of_one_task_has_nothing_to_find(spark):
    rows = [("t", i, i, "h", i % 2) for i in range(50)]
    assert near_across(calls_of(spark, rows), 8, 3).collect() == []
