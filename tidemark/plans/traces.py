"""Event relations derived from general tables, so that every operator has data with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import short_hash, with_content_hash
from ..schema import metadata
from ..tables import read_table


def event_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as tasks: views are model calls, clicks and purchases tool calls, the rest results."""
    raw = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    raw = raw.withColumn("k", k)
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    user, k = F.col("user_id"), F.col("k")
    call = kind.isin("click", "purchase")
    write = F.when((kind == "purchase") & (k % 5 == 0), True).when(call & (k % 5 < 4), False)
    return raw.select(
        F.concat(F.lit("u"), user).alias("task_id"),
        (F.row_number().over(order) - 1).cast("long").alias("step_index"),
        F.when(kind == "view", "llm_call").when(call, "tool_call").otherwise("tool_result").alias("event_type"),
        kind.alias("name"),
        short_hash(F.concat(F.lit("k"), k % 25)).alias("content_hash"),
        (k * 10).alias("tokens_in"),
        F.when(k % 3 > 0, k).alias("tokens_out"),
        F.when(kind == "signup", "ok").when(kind == "error", "error").alias("outcome"),
        "ts",
        F.when(k % 4 > 0, F.round(F.col("value") / 1000, 6)).alias("cost_usd"),
        F.when((kind == "view") & (k % 7 > 0), F.concat(F.lit("m"), k % 3)).alias("model"),
        F.lit(None).cast("long").alias("parent_id"),
        F.when(user % 4 > 0, F.concat(F.lit("w"), user % 4)).alias("workflow"),
        metadata(
            write=write,
            response_hash=F.when((kind == "view") & (k % 3 > 0), F.floor(F.col("value") / 40) % 3),
            cost_basis=F.when(k % 6 == 0, "estimated"),
            synthesized_cost_only=F.when(k == 97, True),
            parent_task_id=F.when(user % 10 == 0, F.concat(F.lit("u"), user + 1)),
            parent_task_link_kind=F.when(user % 20 == 0, "continuation").when(user % 10 == 0, "spawn"),
            task_id_source=F.when(user % 3 == 0, "conversation_id").when(user % 3 == 1, "trace_id_fallback"),
            hash_spec=F.lit("v1"),
        ),
    )


def event_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with parents: a third hang on an earlier step, some on steps that their task lacks; and with fingerprints."""
    k, step = F.col("k"), F.col("step_index")
    events = event_trace(spark, sf_dir).withColumn("k", F.expr("tokens_in div 10"))
    parent = F.when((k % 3 == 0) & (step > 3), step - 1 - k % 3 - F.floor(k / 3) % 3).when(k % 17 == 1, step + 100_000)
    mark = F.substring(F.sha2(F.concat(F.lit("f"), k % 25).cast("binary"), 256), 1, 16)
    held = events.withColumn("parent_id", parent.cast("long")).withColumn("metadata", F.col("metadata").withField("similarity_fingerprint", F.when(k % 10 > 0, mark)))
    return held.drop("k")


def embedding_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as calls: 64 signs are the fingerprint, the label the name, seven tasks."""
    raw = read_table(spark, sf_dir, "embeddings")
    digit = lambda x, i: F.get(x, i).cast("double") > 0
    bits = F.col("embedding")
    nibbles = [F.conv(sum(F.when(digit(bits, 4 * n + b), 8 >> b).otherwise(0) for b in range(4)).cast("string"), 10, 16) for n in range(16)]
    mark = F.lower(F.concat(*nibbles))
    task = F.col("vec_id") % 7
    return raw.select(
        F.concat(F.lit("t"), task).alias("task_id"),
        F.expr("vec_id div 7").alias("step_index"),
        F.lit("llm_call").alias("event_type"),
        F.concat(F.lit("l"), "label").alias("name"),
        F.concat(F.lit("h"), "vec_id").alias("content_hash"),
        *[F.lit(None).cast("long").alias(c) for c in ("tokens_in", "tokens_out")],
        F.lit(None).cast("string").alias("outcome"),
        F.timestamp_seconds(F.col("vec_id")).alias("ts"),
        F.lit(None).cast("double").alias("cost_usd"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("long").alias("parent_id"),
        F.lit(None).cast("string").alias("workflow"),
        metadata(similarity_fingerprint=mark, similarity_spec=F.lit("v2")),
    )


def conversation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events with real content hashes."""
    raw = read_table(spark, sf_dir, "conversations")
    hashed = with_content_hash(raw, "text")
    return hashed.select(
        F.concat(F.lit("c"), "conv_id").alias("task_id"),
        F.col("turn").alias("step_index"),
        F.when(F.col("role") == "assistant", "llm_call").when(F.col("role") == "user", "tool_call").otherwise("tool_result").alias("event_type"),
        F.col("role").alias("name"),
        "content_hash",
        "masked_spans",
        "text",
    )


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans: the order is the parent, the ship day the start, the quantity the days it takes."""
    raw = read_table(spark, sf_dir, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("long")
    return raw.select(
        F.col("l_orderkey").alias("parent"),
        (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("span_id"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"),
        "l_returnflag",
        "l_linenumber",
    )
