"""Repeats across tasks: the latest earlier call of another task that is equal or near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import is_call
from ..tables import materialise
from .repeats import SIGNATURE, THRESHOLD, fingerprint_bits
from .scan import PART, in_parts, running_count, within

#: Earlier events of the same type and name that are compared one by one; beyond them bands decide.
WINDOW = 4096
#: Calls of a band that are compared at once, looking back.
BLOCK = 256
_TIME = ("ts", "task_id", "step_index")


def candidates(events: DataFrame, *claimed: DataFrame) -> DataFrame:
    """Calls with a time that are no repeats within their task."""
    out = events.where(is_call() & F.col("ts").isNotNull())
    for pairs in claimed:
        out = out.join(pairs.select("task_id", F.col("repeat_step").alias("step_index")), ["task_id", "step_index"], "left_anti")
    return out


def exact_across(calls: DataFrame, parts: int | None = None) -> DataFrame:
    """Each call's latest earlier call of equal signature in a different task.

    Within a signature in order of time, a call whose neighbour before it is of another
    task has that neighbour; else it has what its neighbour has.  So the last neighbour
    of a different task, carried on, is the answer.  It is carried within parts of equal
    size, and from part to part by one row for each: its last call, and the last one
    before that of another task.
    """
    key, order, place = [*SIGNATURE], [*_TIME], F.struct("task_id", "step_index")
    found = in_parts(calls, key, order, parts)
    found = found.withColumn("_b", F.lag(place).over(W.partitionBy(PART, *key).orderBy(*order)))
    found = found.withColumn("_o", F.last(F.when(F.col("_b.task_id") != F.col("task_id"), F.col("_b")), ignorenulls=True).over(within(key, order)))

    along = W.partitionBy(*key).orderBy(PART)
    ends = found.groupBy(PART, *key).agg(F.max(F.struct(*order, place.alias("last"), "_o")).alias("e")).select(PART, *key, "e.last", F.col("e._o").alias("other"))
    ends = ends.withColumn("before", F.lag("last").over(along))
    other = F.coalesce("other", F.when(F.col("before.task_id") != F.col("last.task_id"), F.col("before")))
    ends = ends.withColumn("other", F.last(other, ignorenulls=True).over(along)).withColumn("beyond", F.lag("other").over(along))
    carried = ends.where("before is not null").select(PART, *key, "before", "beyond")

    found = found.join(carried, [PART, *key], "left")
    found = found.withColumn("o", F.coalesce("_o", F.when(F.col("before.task_id") != F.col("task_id"), F.col("before")).otherwise(F.col("beyond"))))
    return found.where("o is not null").select(
        F.col("o.task_id").alias("original_task"), F.col("o.step_index").alias("original_step"), "task_id", F.col("step_index").alias("repeat_step"),
        *SIGNATURE, "model", "workflow", "cost_usd", "tokens_in", "tokens_out", F.lit(0).alias("distance"), F.lit(True).alias("equal"),
    )


_KIND = ["event_type", "name"]


def _ranked(calls: DataFrame, parts: int | None) -> DataFrame:
    """Calls with a fingerprint, numbered by time within type and name."""
    marked = calls.where("metadata.similarity_fingerprint is not null").withColumn("bits", fingerprint_bits("metadata.similarity_fingerprint"))
    return running_count(marked, _KIND, [*_TIME], "rn", parts=parts)


def _far() -> F.Column:
    return F.bit_count(F.col("bits").bitwiseXOR(F.col("o_bits")))


def _originals(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.col("rn").alias("o_rn"), F.col("bits").alias("o_bits"), F.col("task_id").alias("o_task"), F.col("step_index").alias("o_step"), F.col("content_hash").alias("o_hash"))


def _latest() -> F.Column:
    return F.max(F.struct("o_rn", "o_task", "o_step", "o_hash", _far().cast("int").alias("distance"))).alias("o")


def _in_window(ranked: DataFrame, threshold: int, window: int) -> DataFrame:
    """Rows (task_id, step_index, o): the latest fit among the last ``window`` calls, through blocks of that size that meet the block before them."""
    block = F.expr(f"rn div {window}")
    build = _originals(ranked.withColumn("block", F.explode(F.array(block, block + 1))), *_KIND, "block")
    close = (F.col("o_rn") < F.col("rn")) & (F.col("o_rn") >= F.col("rn") - window)
    met = ranked.withColumn("block", block).join(build, [*_KIND, "block"]).where(close & (F.col("o_task") != F.col("task_id")) & (_far() <= threshold))
    return met.groupBy("task_id", "step_index").agg(_latest())


def _in_bands(older: DataFrame, ranked: DataFrame, threshold: int, window: int, block: int, parts: int | None) -> DataFrame:
    """Rows (task_id, step_index, o): the latest fit beyond the window among calls that share one of four 16-bit bands.

    Calls of a band are numbered by time.  A call looks back from the last one beyond its
    window, block by block, and stops at the first block that holds a fit: what lies
    before can't be later.  Each round looks back twice as far as the one before, at
    calls that found nothing yet.  Bands of one task alone hold nothing to find.
    """
    key = [*_KIND, "band"]
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.shiftrightunsigned("bits", 16 * i).bitwiseAND(F.lit(65535)).alias("v")) for i in range(4)]))
    slim = lambda rows: rows.select(*_KIND, "task_id", "step_index", "content_hash", "bits", "rn").withColumn("band", bands)
    # A call asks before the first one that is too near to it.
    asks = slim(older).withColumns({"at": F.col("rn") - window, "asked": F.lit(0)})
    both = asks.unionByName(slim(ranked).withColumns({"at": F.col("rn"), "asked": F.lit(1)}))
    numbered = materialise(running_count(both, key, ["at", "asked", "task_id", "step_index"], "pos", F.col("asked") == 1, parts))
    held = numbered.where("asked = 1")
    mixed = held.groupBy(*key).agg(F.min("task_id").alias("_a"), F.max("task_id").alias("_z")).where("_a <> _z").select(*key)
    build = _originals(held.join(mixed, key, "left_semi"), *key, "pos").withColumnRenamed("pos", "o_pos").withColumn("block", F.expr(f"(o_pos - 1) div {block}"))
    open_ = materialise(numbered.where("asked = 0 AND pos > 0").join(mixed, key, "left_semi").withColumn("next", F.expr(f"(pos - 1) div {block}")))
    found, reach = None, 1
    while not open_.isEmpty():
        probe = open_.withColumn("block", F.explode(F.sequence(F.col("next"), F.greatest(F.col("next") - (reach - 1), F.lit(0)))))
        fits = (F.col("o_pos") <= F.col("pos")) & (F.col("o_task") != F.col("task_id")) & (_far() <= threshold)
        now = materialise(probe.join(build, [*key, "block"]).where(fits).groupBy(*key, "task_id", "step_index").agg(_latest()))
        found = now if found is None else found.unionByName(now)
        left = open_.join(now, [*key, "task_id", "step_index"], "left_anti").withColumn("next", F.col("next") - reach)
        open_, reach = materialise(left.where("next >= 0")), 2 * reach
    none = ranked.where("false").select("task_id", "step_index", F.struct(F.col("rn").alias("o_rn"), F.col("task_id").alias("o_task"), F.col("step_index").alias("o_step"), F.col("content_hash").alias("o_hash"), F.lit(0).alias("distance")).alias("o"))
    return none if found is None else found.groupBy("task_id", "step_index").agg(F.max("o").alias("o"))


def near_across(calls: DataFrame, threshold: int = THRESHOLD, window: int = WINDOW, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Each call's latest earlier call of another task, equal in type and name, whose fingerprint is near enough.

    The last ``window`` calls are all compared; calls that find nothing there fall back
    to older calls that share one of four 16-bit bands.
    """
    ranked = materialise(_ranked(calls, parts))
    found = materialise(_in_window(ranked, threshold, window))
    older = ranked.where(F.col("rn") > window + 1).join(found.select("task_id", "step_index"), ["task_id", "step_index"], "left_anti")
    both = found.unionByName(_in_bands(older, ranked, threshold, window, block, parts))
    return ranked.join(both, ["task_id", "step_index"]).select(
        F.col("o.o_task").alias("original_task"), F.col("o.o_step").alias("original_step"), "task_id", F.col("step_index").alias("repeat_step"),
        *SIGNATURE, "model", "workflow", "cost_usd", "tokens_in", "tokens_out", F.col("o.distance").alias("distance"), (F.col("o.o_hash") == F.col("content_hash")).alias("equal"),
    )


def across_tasks(events: DataFrame, exact: DataFrame, near: DataFrame, threshold: int = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Exact pairs across tasks, then near ones of the calls that are left."""
    calls = candidates(events, exact, near)
    equal = exact_across(calls)
    rest = candidates(calls, equal)
    return equal.unionByName(near_across(rest, threshold, window))
