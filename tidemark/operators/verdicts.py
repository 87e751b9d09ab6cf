"""Verdicts on exact repeats from three signals: result, write and terminal outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WASTE, LEGIT, UNKNOWN = "waste_supporting", "legit_supporting", "unknown"
VERDICTS = ("confirmed_waste", "likely_legitimate", "unclassified")


def with_signals(pairs: DataFrame) -> DataFrame:
    """Add result_signal, write_signal and terminal_signal."""
    unseen = F.col("original_result").isNull() | F.col("repeat_result").isNull()
    result = F.when(unseen, UNKNOWN).when(F.col("original_result") == F.col("repeat_result"), WASTE).otherwise(LEGIT)
    write = F.when(F.col("write_step").isNotNull(), LEGIT).when(F.col("unknown_step").isNotNull(), UNKNOWN).otherwise(WASTE)
    outcome = F.when(F.col("terminal_outcome") == "error", WASTE).when(F.col("terminal_outcome") == "ok", LEGIT).otherwise(UNKNOWN)
    return pairs.withColumns({"result_signal": result, "write_signal": write, "terminal_signal": outcome})


def verdict() -> Column:
    result, write, outcome = F.col("result_signal"), F.col("write_signal"), F.col("terminal_signal")
    call_waste = (result == WASTE) | (write == WASTE)
    return (
        F.when((result == LEGIT) | (write == LEGIT), "likely_legitimate")
        .when((outcome == LEGIT) & ~call_waste, "likely_legitimate")
        .when((result == WASTE) & (write == WASTE) & (outcome == WASTE), "confirmed_waste")
        .otherwise("unclassified")
    )


def reason() -> Column:
    """One line that says which signals decided."""
    result, write, outcome = F.col("result_signal"), F.col("write_signal"), F.col("terminal_signal")
    # The sentences of the reasons.
    result_note = F.when(result == UNKNOWN, "result not observable for one or both calls").when(result == WASTE, "result identical").otherwise("result changed")
    write_note = (
        F.when(write == LEGIT, F.concat(F.lit("write intervened at step "), F.col("write_step")))
        .when(write == UNKNOWN, "write status not recorded for at least one intervening tool call")
        .otherwise("no intervening write")
    )
    outcome_note = F.when(outcome == WASTE, "task terminated in failure").when(outcome == LEGIT, "task terminated in success").otherwise("task terminal outcome not recorded")
    tension = "task succeeded, but that doesn't confirm this specific repeated call contributed: task-level outcome isn't a substitute for the missing call-level answer"
    only = lambda signal, is_, note: F.when(signal == is_, note)
    unknowns = F.concat_ws("; ", only(result, UNKNOWN, result_note), only(write, UNKNOWN, write_note), only(outcome, UNKNOWN, outcome_note))
    return (
        F.when((result == LEGIT) | (write == LEGIT), F.concat_ws("; ", only(result, LEGIT, result_note), only(write, LEGIT, write_note)))
        .when((outcome == LEGIT) & (result == UNKNOWN) & (write == UNKNOWN), outcome_note)
        .when((result == WASTE) & (write == WASTE) & (outcome == WASTE), F.concat_ws("; ", result_note, write_note, outcome_note))
        .when(outcome == LEGIT, F.concat_ws("; ", result_note, write_note, F.lit(tension)))
        .otherwise(F.when(unknowns == "", F.concat_ws("; ", result_note, write_note, outcome_note)).otherwise(F.concat(F.lit("no legitimate-use signal fired, but "), unknowns)))
    )


def classified(pairs: DataFrame) -> DataFrame:
    """Pairs with signals, verdict and reason."""
    return with_signals(pairs).withColumn("verdict", verdict()).withColumn("reason", reason())
