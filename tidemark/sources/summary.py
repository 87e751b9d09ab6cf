"""What a conversion made: counts by kind, content, cost and task id, in one pass over its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SYNTHESIZED_BASIS

#: Shown instead of values that an event lacks.
NONE = "(none)"


def summary(events: DataFrame) -> DataFrame:
    """Rows (measure, value, events, usd): how many events have each value of each measure, and their dollars."""
    meta = lambda name: F.coalesce(F.col(f"metadata.{name}"), F.lit(NONE))
    billed = F.coalesce(F.col("metadata.synthesized_cost_only"), F.lit(False))
    cost = F.when(billed, SYNTHESIZED_BASIS).when(F.col("cost_usd").isNull(), NONE).otherwise(F.coalesce("metadata.cost_basis", F.lit("reported")))
    model = F.when(F.col("metadata.model_basis").isNotNull(), F.col("metadata.model_basis")).otherwise(F.when(F.coalesce(F.col("model"), F.lit("")) == "", NONE).otherwise("reported"))
    write = F.when(F.col("event_type") == "tool_call", F.when(F.col("metadata.write").isNull(), NONE).otherwise(F.col("metadata.write").cast("string")))
    measures = {
        "event type": F.col("event_type"),
        "content": meta("content_basis"),
        "cost": F.when(F.col("event_type") == "llm_call", cost),
        "model": model,
        "task id": meta("task_id_source"),
        "parent task": F.when(F.col("metadata.parent_task_id").isNotNull(), meta("parent_task_link_kind")),
        "tool writes": write,
        "outcome": F.coalesce("outcome", F.lit(NONE)),
    }
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), value.alias("value")) for name, value in measures.items()])).alias("m")
    rows = events.select(each, F.col("cost_usd").cast("decimal(38,9)").alias("usd")).where("m.value is not null")
    return rows.groupBy("m.measure", "m.value").agg(F.count("*").alias("events"), F.round(F.coalesce(F.sum("usd"), F.lit(0)).cast("double"), 6).alias("usd"))


def lines(events: DataFrame) -> list[str]:
    """The summary as lines, a measure each; there are few values."""
    held: dict[str, list] = {}
    for r in summary(events).orderBy("measure", F.col("events").desc(), "value").collect():
        held.setdefault(r["measure"], []).append(f"{r['value']} {r['events']}" + (f" (${r['usd']:,.4f})" if r["measure"] == "cost" and r["usd"] else ""))
    return [f"{measure}: {', '.join(values)}" for measure, values in held.items()]
