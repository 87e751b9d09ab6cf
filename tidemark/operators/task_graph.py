"""The graph of tasks: edges, components, continuation chains, call sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialise
from .scan import PART, in_parts


def task_edges(events: DataFrame) -> DataFrame:
    """Rows (task_id, parent_task_id, link_kind): the parent on which a task's events agree, else null.

    The kind is that of the first event that reports a parent.
    """
    parent, kind = F.col("metadata.parent_task_id"), F.col("metadata.parent_task_link_kind")
    named = F.when(parent.isNotNull(), F.struct("step_index", kind.alias("kind")))
    found = events.groupBy("task_id").agg(F.min(parent).alias("lo"), F.max(parent).alias("hi"), F.min(named)["kind"].alias("kind"))
    agreed = F.col("lo") == F.col("hi")
    return found.select("task_id", F.when(agreed, F.col("lo")).alias("parent_task_id"), F.when(agreed, F.col("kind")).alias("link_kind"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (task_id, component) for every task and every parent, component being the least task id reachable.

    A task has at most one parent, so pointers double: after n rounds they span 2**n hops.
    """
    nodes = edges.select("task_id").unionAll(edges.where("parent_task_id is not null").select("parent_task_id")).distinct()
    up = edges.where("parent_task_id is not null").select("task_id", "parent_task_id")
    state = nodes.join(up, "task_id", "left").select("task_id", F.coalesce("parent_task_id", "task_id").alias("top"))
    state = materialise(state.withColumn("least", F.least("task_id", "top")))
    while True:
        above = state.select(F.col("task_id").alias("top"), F.col("top").alias("_top"), F.col("least").alias("_least"))
        following = materialise(state.join(above, "top").select("task_id", F.col("_top").alias("top"), F.least("least", "_least").alias("least"), (F.col("_top") != F.col("top")).alias("moved"), (F.col("_least") < F.col("least")).alias("fell")))
        # On a cycle pointers move for ever, but the least id of the cycle stands once it has gone round.
        done = following.agg(F.max(F.col("fell")), F.max(F.col("moved"))).head()
        state = following.drop("moved", "fell")
        if not done[0] and (not done[1] or not _open_ends(state)):
            break
    roots = state.groupBy("top").agg(F.min("least").alias("component"))
    return state.join(roots, "top").select("task_id", "component")


def _open_ends(state: DataFrame) -> bool:
    """Whether some pointer ends neither at a root nor on a cycle that it has gone round."""
    ends = state.select(F.col("task_id").alias("top"), F.col("top").alias("_again"), F.col("least").alias("_least"))
    return not state.join(ends, "top").where("top <> _again and _least < least").isEmpty()


def continuation_hops(edges: DataFrame) -> DataFrame:
    """Rows (tip, hop, successor, predecessor): the chain from each tip back to its root.

    A tip has no continuation of its own; pure cycles have none and vanish, and a chain
    that runs into a cycle ends before it meets a task again.  Each round doubles the
    hops known, so a chain of n hops takes about log2(n) rounds.
    """
    links = _up(edges)
    tips = links.join(links.select(F.col("parent_task_id").alias("task_id")), "task_id", "left_anti")
    found = tips.select(F.col("task_id").alias("tip"), F.lit(0).cast("long").alias("hop"), F.col("task_id").alias("successor"))
    # Where a task's chain is after ``step`` hops, as long as it goes on from there.
    jump, step = links.join(links.select(F.col("task_id").alias("parent_task_id")), "parent_task_id", "left_semi").select("task_id", F.col("parent_task_id").alias("to")), 1
    while True:
        on = found.join(jump, F.col("successor") == F.col("task_id")).groupBy("tip", F.col("to").alias("successor")).agg(F.min(F.col("hop") + step).alias("hop"))
        on = materialise(on.join(found, ["tip", "successor"], "left_anti").select("tip", "hop", "successor"))
        if on.isEmpty():
            break
        found = materialise(found.unionByName(on))
        jump, step = materialise(jump.join(jump.select(F.col("task_id").alias("to"), F.col("to").alias("_to")), "to").select("task_id", F.col("_to").alias("to"))), 2 * step
    return found.join(links, F.col("successor") == F.col("task_id")).select("tip", "hop", "successor", F.col("parent_task_id").alias("predecessor"))


def _up(edges: DataFrame) -> DataFrame:
    return materialise(edges.where("link_kind = 'continuation' and parent_task_id is not null").select("task_id", "parent_task_id"))


def _labelled(links: DataFrame) -> DataFrame:
    """Links with the root of their chain and the successor's depth below it; null where a chain runs into a cycle.

    Pointers double until all have come to a root; after log2(links) rounds more than
    the longest chain is spanned, and what has none by then goes round.
    """
    roots = links.select(F.col("parent_task_id").alias("task_id")).distinct().join(links, "task_id", "left_anti").withColumn("root", F.lit(True))
    state = links.join(roots.select(F.col("task_id").alias("parent_task_id"), "root"), "parent_task_id", "left")
    state = materialise(state.select("task_id", F.col("parent_task_id").alias("to"), F.lit(1).cast("long").alias("depth"), F.coalesce("root", F.lit(False)).alias("done")))
    for _ in range(links.count().bit_length()):
        if state.where("not done").isEmpty():
            break
        above = state.select(F.col("task_id").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        state = materialise(state.where("done").unionByName(state.where("not done").join(above, "to").select("task_id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))))
    return links.join(state.where("done").select("task_id", F.col("to").alias("root"), "depth"), "task_id", "left")


def continuation_links(edges: DataFrame) -> DataFrame:
    """Rows (successor, predecessor, root, depth): the hops of all chains, each once.

    Every link of a tree lies on the chain of some tip.  Chains that run into a cycle are
    followed tip by tip, as each leaves out another link of it, and have no root.
    """
    links = materialise(_labelled(_up(edges)))
    trees = links.where("root is not null").select(F.col("task_id").alias("successor"), F.col("parent_task_id").alias("predecessor"), "root", "depth")
    rest = links.where("root is null")
    if rest.isEmpty():
        return trees
    round_ = continuation_hops(rest.select("task_id", "parent_task_id", F.lit("continuation").alias("link_kind"))).select("successor", "predecessor").distinct()
    return trees.unionByName(round_.withColumns({"root": F.lit(None).cast("string"), "depth": F.lit(None).cast("long")}))


def continuation_tips(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (successor, predecessor, root, depth, first_tip, last_tip): hops of trees with the tips whose chains they are on.

    Tips of a root are numbered in the order of an Euler tour, so those beyond a hop are
    a range, and a chain is the hops whose ranges hold its tip's number: as many rows as
    hops, however many chains share them.  The tour is a list of steps, down each link
    and up again; it is ranked by doubling.
    """
    links = materialise(_labelled(_up(edges)).where("root is not null"))
    # Brothers in order, also over the borders of parts.
    placed = in_parts(links, ["parent_task_id"], ["task_id"], parts)
    firsts = placed.groupBy(PART, "parent_task_id").agg(F.min("task_id").alias("_first"), F.max("task_id").alias("task_id"))
    later = firsts.withColumn("_beyond", F.lead("_first").over(W.partitionBy("parent_task_id").orderBy(PART))).select("task_id", "_beyond")
    eldest = firsts.groupBy(F.col("parent_task_id").alias("task_id")).agg(F.min("_first").alias("child"))
    placed = placed.withColumn("_next", F.lead("task_id").over(W.partitionBy(PART, "parent_task_id").orderBy("task_id")))
    placed = materialise(placed.join(later, "task_id", "left").join(eldest, "task_id", "left").select("task_id", "parent_task_id", "root", "depth", "child", F.coalesce("_next", "_beyond").alias("brother")))

    step = lambda task, down: F.struct(task.alias("task"), F.lit(down).alias("down"))
    own, above = F.col("task_id"), F.when(F.col("parent_task_id") != F.col("root"), step(F.col("parent_task_id"), False))
    down = placed.select(step(own, True).alias("at"), F.when(F.col("child").isNotNull(), step(F.col("child"), True)).otherwise(step(own, False)).alias("to"), F.col("child").isNull().cast("long").alias("tips"))
    up = placed.select(step(own, False).alias("at"), F.when(F.col("brother").isNotNull(), step(F.col("brother"), True)).otherwise(above).alias("to"), F.lit(0).cast("long").alias("tips"))
    state = materialise(down.unionByName(up))
    while not state.where("to is not null").isEmpty():
        ahead = state.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("tips").alias("_tips"))
        on = state.where("to is not null").join(ahead, "to").select("at", F.col("_to").alias("to"), (F.col("tips") + F.col("_tips")).alias("tips"))
        state = materialise(state.where("to is null").unionByName(on))
    # What is still to come of a root's tips, from a step on, is counted back from all of them.
    left = state.groupBy(F.col("at.task").alias("task_id")).agg(F.max(F.when(F.col("at.down"), F.col("tips"))).alias("_from"), F.max(F.when(~F.col("at.down"), F.col("tips"))).alias("_after"))
    met = links.join(left, "task_id")
    every = met.groupBy("root").agg(F.max("_from").alias("_every"))
    return met.join(every, "root").select(F.col("task_id").alias("successor"), F.col("parent_task_id").alias("predecessor"), "root", "depth", (F.col("_every") - F.col("_from") + 1).alias("first_tip"), (F.col("_every") - F.col("_after")).alias("last_tip"))


def call_sequences(events: DataFrame) -> DataFrame:
    """Rows (task_id, calls): each task's calls in order of steps."""
    calls = events.where(F.col("event_type").isin("llm_call", "tool_call"))
    row = F.struct("step_index", "event_type", "name", F.col("metadata.similarity_fingerprint").alias("fingerprint"))
    return calls.groupBy("task_id").agg(F.array_sort(F.collect_list(row)).alias("calls"))
