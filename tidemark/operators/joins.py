"""The time-ordered joins of telemetry: nearest, interval, positional, as-of, watermark.

All are windows or equi-joins over the key that they share; none compares all pairs.
Callers pass frames with the columns named in each docstring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_from_nearest_call(events: DataFrame) -> DataFrame:
    """Models of events without one, from the model call nearest by position in (task, workflow).

    Ties go to the earlier call.  If the nearest call has no model the event keeps none.
    """
    key = ["task_id", "workflow"]
    order = W.partitionBy(*key).orderBy("step_index")
    back = W.partitionBy(*key).orderBy(F.col("step_index").desc())
    at = events.withColumn("_rn", F.row_number().over(order))
    own = F.when(F.col("event_type") == "llm_call", F.struct("_rn", "model"))
    at = at.withColumn("_own", own)
    at = at.withColumn("_p", F.last("_own", ignorenulls=True).over(order)).withColumn("_f", F.last("_own", ignorenulls=True).over(back))
    earlier = F.col("_f").isNull() | (F.col("_rn") - F.col("_p._rn") <= F.col("_f._rn") - F.col("_rn"))
    near = F.when(F.col("_p").isNotNull() & earlier, F.col("_p.model")).otherwise(F.col("_f.model"))
    needs = (F.col("event_type") != "llm_call") & (F.coalesce(F.col("model"), F.lit("")) == "") & (F.coalesce(near, F.lit("")) != "")
    basis = F.when(F.col("_p").isNotNull() & earlier, "preceding_llm_call").otherwise("following_llm_call")
    return at.withColumn("model_basis", F.when(needs, basis)).withColumn("model", F.when(needs, near).otherwise(F.col("model"))).drop("_rn", "_own", "_p", "_f")


def claim_first_in_window(starts: DataFrame, points: DataFrame) -> DataFrame:
    """Each window, from one start to the next of its session, claims the first point in it.

    starts: session, at, start_id; points: session, at, point_id.  Rows (session, start_id, point_id).
    One union and one running value; a point belongs to the last start at or before it.
    """
    both = starts.select("session", "at", F.lit(0).alias("kind"), F.col("start_id").alias("id")).unionByName(points.select("session", "at", F.lit(1).alias("kind"), F.col("point_id").alias("id")))
    order = W.partitionBy("session").orderBy("at", "kind", "id")
    held = both.withColumn("start_id", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(order))
    held = held.where("kind = 1 and start_id is not null")
    first = held.groupBy("session", "start_id").agg(F.min(F.struct("at", "id"))["id"].alias("point_id"))
    return first


def as_of(points: DataFrame, ends: DataFrame) -> DataFrame:
    """Each point's latest end at or before it, within its session.

    points: session, at, point_id; ends: session, at, end_id.  Rows (session, point_id, end_id), end_id null if none.
    """
    both = ends.select("session", "at", F.lit(0).alias("kind"), F.col("end_id").alias("id")).unionByName(points.select("session", "at", F.lit(1).alias("kind"), F.col("point_id").alias("id")))
    order = W.partitionBy("session").orderBy("at", "kind", "id")
    held = both.withColumn("end_id", F.last(F.when(F.col("kind") == 0, F.col("id")), ignorenulls=True).over(order))
    return held.where("kind = 1").select("session", F.col("id").alias("point_id"), "end_id")


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """The nth row of a session on the left with the nth on the right, if their names go together.

    Both: session, at, id, name.  Rows (session, n, left_id, right_id).
    """
    order = W.partitionBy("session").orderBy("at", "id")
    l = left.withColumn("n", F.row_number().over(order)).select("session", "n", F.col("id").alias("left_id"), F.col("name").alias("_l"))  # noqa: E741
    r = right.withColumn("n", F.row_number().over(order)).select("session", "n", F.col("id").alias("right_id"), F.col("name").alias("_r"))
    return l.join(r, ["session", "n"]).where(F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_l") == F.col("_r"))).select("session", "n", "left_id", "right_id")


def chain_siblings(spans: DataFrame) -> DataFrame:
    """Under one parent, a span that starts at or after the tail's end hangs on the tail, else on the parent.

    spans: parent, span_id, start, end.  The tail is the earlier sibling with the largest
    end, the later one of equals.  Rows (parent, span_id, tail_id, chained).
    """
    order = W.partitionBy("parent").orderBy("start", "span_id")
    numbered = spans.withColumn("_rn", F.row_number().over(order))
    tail = F.max(F.struct(F.col("end").alias("e"), F.col("_rn").alias("rn"), F.col("span_id").alias("id"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    held = numbered.withColumn("t", tail)
    chained = F.coalesce(F.col("start") >= F.col("t.e"), F.lit(False))
    return held.select("parent", "span_id", F.when(chained, F.col("t.id")).alias("tail_id"), chained.alias("chained"))


def chain_all(spans: DataFrame) -> DataFrame:
    """Under one parent every span hangs on the one before it."""
    order = W.partitionBy("parent").orderBy("start", "span_id")
    return spans.select("parent", "span_id", F.lag("span_id").over(order).alias("previous_id"))


def nearest_kept_ancestor(spans: DataFrame) -> DataFrame:
    """Rows (trace, span_id, ancestor): the nearest ancestor that is kept, null if there is none.

    spans: trace, span_id, parent_id, kept.  Traces come one after another in batches of
    many; what was found for a span's parent is remembered, so each span costs one step.
    """

    def walk(table: pa.Table) -> pa.Table:
        traces, ids, parents, kept = (table[c].to_pylist() for c in ("trace", "span_id", "parent_id", "kept"))
        row = {key: i for i, key in enumerate(zip(traces, ids, strict=True))}
        up = [row.get((t, p)) for t, p in zip(traces, parents, strict=True)]
        known: dict[int, object] = {}
        for start in range(len(ids)):
            path, seen, at = [], set(), start
            while at is not None and at not in known and at not in seen:
                seen.add(at)
                path.append(at)
                at = up[at]
            if at is not None and at not in known:  # a cycle: each of its spans looks around for itself
                for i in path:
                    around, above = {i}, up[i]
                    while above is not None and not kept[above] and above not in around:
                        around.add(above)
                        above = up[above]
                    known[i] = None if above is None or above in around else ids[above]
                continue
            for i in reversed(path):
                above = up[i]
                known[i] = None if above is None else ids[above] if kept[above] else known.get(above)
        return pa.table({"trace": table["trace"], "span_id": table["span_id"], "ancestor": pa.array([known[i] for i in range(len(ids))], table.schema.field("span_id").type)})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(0)
            last = column[len(batch) - 1]
            cut = len(batch)
            while cut and column[cut - 1] == last:
                cut -= 1
            if cut:  # the last trace may go on
                yield from walk(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            elif held and held[-1].column(0)[len(held[-1]) - 1] != last:
                yield from walk(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from walk(pa.Table.from_batches(held)).to_batches()

    kinds = dict(spans.dtypes)
    ordered = spans.select("trace", "span_id", "parent_id", "kept").repartition("trace").sortWithinPartitions("trace")
    return ordered.mapInArrow(walked, f"trace {kinds['trace']}, span_id {kinds['span_id']}, ancestor {kinds['span_id']}")


def pair_greedily(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """Each call takes the last end before its own that no earlier call took, within its trace.

    calls: trace, end, call_id; ends: trace, end, end_id.  Rows (trace, call_id, end_id).

    Ends pile up and calls take from the top, so the height of the pile tells who meets
    whom: a call at height h takes the last end that raised the pile to h.  The height is
    a running sum that never falls below zero.
    """
    both = calls.select("trace", "end", F.lit(1).alias("kind"), F.col("call_id").alias("id")).unionByName(ends.select("trace", "end", F.lit(0).alias("kind"), F.col("end_id").alias("id")))
    order = W.partitionBy("trace").orderBy("end", "kind", "id")
    held = both.withColumn("place", F.row_number().over(order)).withColumn("sum", F.sum(F.when(F.col("kind") == 0, 1).otherwise(-1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    held = held.withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))))
    level = F.when(F.col("kind") == 0, F.col("height")).otherwise(F.coalesce(F.lag("height").over(order), F.lit(0)))
    held = held.withColumn("level", level)
    taken = F.lag(F.when(F.col("kind") == 0, F.col("id"))).over(W.partitionBy("trace", "level").orderBy("place"))
    return held.withColumn("end_id", F.when(F.col("level") > 0, taken)).where("kind = 1").select("trace", F.col("id").alias("call_id"), "end_id")


def apportion(total: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Each call's part of its group's dollars by tokens, equal parts if there are none, to six decimals.

    total: keys, usd; calls: keys, call_id, tokens.  Rows (keys, call_id, usd).
    """
    own = W.partitionBy(*keys)
    shared = calls.join(total, keys).withColumn("_sum", F.sum("tokens").over(own)).withColumn("_n", F.count("*").over(own))
    part = F.when(F.col("_sum") > 0, F.col("usd") * F.col("tokens") / F.col("_sum")).otherwise(F.col("usd") / F.col("_n"))
    return shared.select(*keys, "call_id", (F.floor(part * 1e6 + 0.5) / 1e6).alias("usd"))


def latest_points(points: DataFrame) -> DataFrame:
    """Of a cumulative counter's points the last of each generation.  points: channel, model, start, at, value."""
    return points.groupBy("channel", "model", "start").agg(F.max(F.struct("at", "value"))["value"].alias("value"))


def generation_windows(starts: DataFrame) -> DataFrame:
    """Half-open windows of counter generations: from a start to the next; the first and last are open.

    starts: channel, model, start.  Rows with start, lo and hi (null: open).
    """
    order = W.partitionBy("channel", "model").orderBy("start")
    return starts.select("channel", "model", "start", F.when(F.row_number().over(order) > 1, F.col("start")).alias("lo"), F.lead("start").over(order).alias("hi"))


def to_generation(calls: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows (channel, model, call_id, start): the generation that a call falls into, by one running value.

    calls: channel, model, at, call_id.  Calls before the first start belong to the first.
    """
    both = starts.select("channel", "model", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(dict(calls.dtypes)["call_id"]).alias("call_id")).unionByName(calls.select("channel", "model", "at", F.lit(1).alias("kind"), "call_id"))
    key = W.partitionBy("channel", "model")
    order = key.orderBy("at", "kind")
    own = F.when(F.col("kind") == 0, F.col("at"))
    held = both.withColumn("start", F.coalesce(F.last(own, ignorenulls=True).over(order), F.min(own).over(key)))
    return held.where("kind = 1 and start is not null").select("channel", "model", "call_id", "start")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left without a partner: what becomes a billing-only event."""
    return left.join(right, keys, "left_anti")
