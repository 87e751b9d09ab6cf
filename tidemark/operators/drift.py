"""Drift hints: how the calls of a continued task differ from those of its predecessor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .task_graph import call_sequences, continuation_hops, continuation_links

_STEP = "array<struct<event_type:string,name:string,step_index:bigint>>"
HINT = (
    "predecessor string, successor string, predecessor_calls int, successor_calls int, shape_distance int, shape_fraction double, "
    f"content_distances array<struct<before:bigint,after:bigint,distance:int>>, added {_STEP}, removed {_STEP}, "
    "substituted array<struct<before:struct<event_type:string,name:string,step_index:bigint>,after:struct<event_type:string,name:string,step_index:bigint>>>"
)


def _next_row(row: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The row of distances below one; same: which symbols of the other sequence the new row's symbol equals.

    A cell is the least of what comes from above and its left neighbour plus one; less
    its column's number, that is a running minimum.
    """
    out = np.empty_like(row)
    out[0] = row[0] + 1
    np.minimum(row[:-1] + ~same, row[1:] + 1, out=out[1:])
    columns = np.arange(len(row), dtype=row.dtype)
    out -= columns
    np.minimum.accumulate(out, out=out)
    out += columns
    return out


def align(a: list, b: list) -> tuple[int, list[tuple[int | None, int | None]]]:
    """(edit distance, alignment) of two sequences of signatures.

    The way back prefers a pair, then a removal, then an addition.  It needs the whole
    table, of which only every k-th row is kept, k being the root of their number; the
    rows between two of these are made again when the way back comes there, as far to
    the right as it still can go.  So 20,000 calls against 20,000 take some 25 MB.
    """
    names = {s: i for i, s in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([names[s] for s in a], np.int32), np.array([names[s] for s in b], np.int32)
    n, m = len(x), len(y)
    every = int(n**0.5) + 1
    row, kept = np.arange(m + 1, dtype=np.int32), []
    for i in range(n):
        if i % every == 0:
            kept.append(row)
        row = _next_row(row, y == x[i])
    distance, pairs, i, j = int(row[m]), [], n, m
    while i:
        top = (i - 1) // every * every
        rows = [kept[top // every][: j + 1]]
        for k in range(top, i):
            rows.append(_next_row(rows[-1], y[:j] == x[k]))
        while i > top:
            here, above = rows[i - top], rows[i - top - 1]
            if j and here[j] == above[j - 1] + (x[i - 1] != y[j - 1]):
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif here[j] == above[j] + 1:
                i -= 1
                pairs.append((i, None))
            else:
                j -= 1
                pairs.append((None, j))
    pairs += [(None, k) for k in range(j - 1, -1, -1)]
    return distance, pairs[::-1]


def compare(before: list[dict], after: list[dict]) -> tuple:
    """The columns of a hint after the two task ids."""
    sign = lambda c: (c["event_type"], c["name"])
    show = lambda c: {k: c[k] for k in ("event_type", "name", "step_index")}
    distance, pairs = align([sign(c) for c in before], [sign(c) for c in after])
    content, added, removed, swapped = [], [], [], []
    for i, j in pairs:
        if i is None:
            added.append(show(after[j]))
        elif j is None:
            removed.append(show(before[i]))
        elif sign(before[i]) != sign(after[j]):
            swapped.append({"before": show(before[i]), "after": show(after[j])})
        elif before[i]["fingerprint"] and after[j]["fingerprint"]:
            far = (int(before[i]["fingerprint"], 16) ^ int(after[j]["fingerprint"], 16)).bit_count()
            content.append({"before": before[i]["step_index"], "after": after[j]["step_index"], "distance": far})
    return len(before), len(after), distance, distance / max(len(before), len(after), 1), content, added, removed, swapped


def drift_hints(events: DataFrame, edges: DataFrame, dedupe_hops: bool = True) -> DataFrame:
    """A hint for each hop of each continuation chain.

    Chains that share a beginning share its hops; with dedupe_hops each is compared once.
    """
    hops = (continuation_links if dedupe_hops else continuation_hops)(edges).select("predecessor", "successor")
    calls = call_sequences(events)
    none = F.array().cast(calls.schema["calls"].dataType)
    met = hops.join(calls.select(F.col("task_id").alias("predecessor"), F.col("calls").alias("before")), "predecessor", "left")
    met = met.join(calls.select(F.col("task_id").alias("successor"), F.col("calls").alias("after")), "successor", "left")
    met = met.select("predecessor", "successor", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
    schema = met.sparkSession.createDataFrame([], HINT).schema

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [(r["predecessor"], r["successor"], *compare(r["before"], r["after"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in rows], target)

    return met.mapInArrow(compared, HINT)
