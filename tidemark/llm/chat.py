"""Chat formatting after a cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation once after every turn.  Each turn gets a rolling hash
of all turns up to it; a conversation whose last hash is that of an earlier turn of
another one is a snapshot and goes, by anti-join, as do equal conversations but the
one of least id.  What is left is rendered.

Defined results: a null role or text differs from an empty one in the hashes and is
rendered as empty; turns are in order of turn, role and text, nulls first, and exact
repeats of a row count once; rows without a conversation id are a conversation each, so
no number of them makes one task large; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_hashes(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, own, place, n_turns, role, text, prefix): prefix is two 64-bit hashes of the turns up to place.

    own tells conversations without an id apart; it is null for the others.

    A turn's hash covers its place, so the exclusive or of the hashes up to it names
    the sequence and is a running window aggregate.
    """
    turns = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    hashes = F.struct(*[F.xxhash64(F.lit(seed), "turn", F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(name) for seed, name in ((3, "a"), (4, "b"))])
    turns = turns.withColumn("own", F.when(F.col("conv_id").isNull(), hashes))
    own = W.partitionBy("conv_id", "own")
    ordered = own.orderBy("turn", "role", "text")
    turns = turns.withColumn("place", F.row_number().over(ordered)).withColumn("n_turns", F.count("*").over(own))

    def rolling(seed: int) -> Column:
        each = F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        return F.bit_xor(each).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))

    return turns.select("conv_id", "own", "place", "n_turns", "role", "text", F.struct(rolling(1).alias("a"), rolling(2).alias("b")).alias("prefix"))


def maximal_conversations(turns: DataFrame, **columns: str) -> DataFrame:
    """Rows (conv_id, own, place, role, text) of the conversations that aren't a prefix of a longer one, equal ones once."""
    hashed = rolling_hashes(turns, **columns)
    ends = hashed.where("place = n_turns").select("conv_id", "own", "n_turns", "prefix")
    ends = ends.groupBy("n_turns", "prefix").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("named"), "conv_id", "own")).alias("least")).select("n_turns", "prefix", "least.conv_id", "least.own")
    longer = hashed.where("place < n_turns").select(F.col("place").alias("n_turns"), "prefix").distinct()
    kept = ends.join(longer, ["n_turns", "prefix"], "left_anti").select(F.col("conv_id").alias("kept_id"), F.col("own").alias("kept_own"))
    return hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")) & F.col("own").eqNullSafe(F.col("kept_own")), "left_semi").select("conv_id", "own", "place", "role", "text")


def render(turns: DataFrame, opening: str = "<|{role}|>\n", closing: str = "\n<|end|>\n") -> DataFrame:
    """Rows (conv_id, n_turns, rendered): each conversation as one string."""
    before, after = opening.split("{role}")
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after), F.coalesce("text", F.lit("")), F.lit(closing))
    lines = turns.select("conv_id", "own", F.struct("place", line.alias("line")).alias("line")).groupBy("conv_id", "own").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
