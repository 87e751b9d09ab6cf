"""Verdicts of a stream against those of a batch over the same events."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.operators.repeats import exact_repeats
from tidemark.operators.verdicts import classified
from tidemark.schema import EVENT
from tidemark.streaming.verdicts import PROVIDER, streaming_verdicts


def events_of(spark, seed, tasks=4, steps=60):
    rng = random.Random(seed)
    rows = []
    for t in range(tasks):
        kind = None
        for s in range(steps):
            kind = "tool_result" if kind == "tool_call" and rng.random() < 0.7 else rng.choice(["llm_call", "tool_call", "tool_call"])
            meta = dict.fromkeys(EVENT["metadata"].dataType.fieldNames())
            if kind == "tool_call":
                meta["write"] = rng.choice([None, False, False, False, True]) if rng.random() < 0.3 else False
            if kind == "llm_call":
                meta["response_hash"] = rng.choice([None, "r1", "r2"])
            if kind == "tool_result" and rng.random() < 0.2:
                meta["content_basis"] = "opaque"
            meta["synthesized_cost_only"] = True if kind == "llm_call" and rng.random() < 0.1 else None
            rows.append(dict.fromkeys(f.name for f in EVENT) | {"task_id": f"t{t}", "step_index": s, "event_type": kind, "name": rng.choice("ab"), "content_hash": rng.choice(["x", "y", "z"]), "outcome": rng.choice([None, "ok", "error"]), "ts": datetime(2024, 1, 1, 0, s // 60, s % 60, tzinfo=timezone.utc), "metadata": meta})
    return spark.createDataFrame(rows, EVENT)


def test_stream_in_three_parts_equals_a_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    events = events_of(spark, 1)
    folder = str(tmp_path / "in")
    columns = ["original_step", "repeat_step", "event_type", "name", "content_hash", "original_result", "repeat_result", "write_step", "unknown_step", "terminal_outcome", "verdict", "reason"]
    latest = {}
    for i, (lo, hi) in enumerate(((0, 20), (20, 41), (41, 60))):
        events.where((F.col("step_index") >= lo) & (F.col("step_index") < hi)).coalesce(1).write.mode("append").parquet(folder)
        stream = streaming_verdicts(spark.readStream.schema(EVENT).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        ended = query.awaitTermination(120)
        query.stop()
        assert ended
        latest = {}
        for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.as_of_step):
            assert not r.final
            latest[r.task_id, r.repeat_step] = tuple(r[c] for c in columns)
        want = {(r.task_id, r.repeat_step): tuple(r[c] for c in columns) for r in classified(exact_repeats(events.where(F.col("step_index") < hi))).collect()}
        assert latest == want and want
    assert len({v[-2] for v in latest.values()}) > 1
    # Hours later: the tasks' last rows once more, as final.
    events.limit(1).withColumns({"task_id": F.lit("z"), "ts": F.col("ts") + F.expr("INTERVAL 9 HOURS")}).write.mode("append").parquet(folder)
    stream = streaming_verdicts(spark.readStream.schema(EVENT).parquet(folder))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    ended = query.awaitTermination(120)
    query.stop()
    final = {(r.task_id, r.repeat_step): tuple(r[c] for c in columns) for r in spark.read.parquet(str(tmp_path / "out")).where("final").collect()}
    assert ended and final == latest
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
