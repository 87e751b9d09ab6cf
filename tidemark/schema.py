"""The event relation: one row per model call, tool call or tool result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL_TYPES = ("llm_call", "tool_call")
EVENT_TYPES = (*CALL_TYPES, "tool_result")
OUTCOMES = ("ok", "error")
UNKNOWN_MODEL, UNLABELED_WORKFLOW = "(unknown model)", "(unlabeled workflow)"
DIRECT_BASIS, SYNTHESIZED_BASIS = "direct_from_source", "synthesized_billing_only"

METADATA = T.StructType(
    [
        T.StructField("write", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("response_hash", "content_basis", "similarity_fingerprint", "similarity_spec", "hash_spec", "cost_basis")],
        T.StructField("synthesized_cost_only", T.BooleanType()),
        *[T.StructField(n, T.StringType()) for n in ("parent_task_id", "parent_task_link_kind", "task_id_source", "source_path", "model_basis")],
    ]
)

EVENT = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("step_index", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("tokens_in", T.LongType()),
        T.StructField("tokens_out", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("workflow", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)


def metadata(**known: Column) -> Column:
    """A metadata struct from the keys given; the others are null."""
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]).alias("metadata")


def is_call() -> Column:
    return F.col("event_type").isin(*CALL_TYPES)


def money(column: str | Column) -> Column:
    """An amount as a decimal, so that sums don't depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,9)")


def dollars(column: Column) -> Column:
    """A decimal sum back as a double with six decimals; null is nothing spent."""
    return F.round(F.coalesce(column, F.lit(0)).cast("double"), 6)
