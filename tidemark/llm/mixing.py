"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares are raised to an exponent and normalised.  The exponent is
searched until the weights' entropy meets a target and no source repeats more often
than a limit.  The weights are realised as block permutations: an epoch is a
permutation of a source's documents by a keyed hash; a source passes whole epochs,
then as much of one more as its token budget allows.  The passes of all sources are
interleaved: a pass's place is how far its source has come by then, from 0 to 1, so
every block of neighbouring places holds the sources by their weights.

The search halves its interval 7 times a round: one aggregate over the table of
sources evaluates 129 exponents.  Sources are never collected, so their number has
no bound; running token sums go over at most 4,096 groups of a source at a time.

Tokens here are runs of other than white space.  Defined results: null texts have
no tokens; null sources are one source; repeated rows stand or fall together; a
source without tokens passes once; an empty table gives an empty result; further
columns, whatever their names, stay as they are in ``mixed_rows`` and are ignored
otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrow import broadcast_if_small, column, materialise

#: Passes of one block, about; also the documents of a group of keys whose tokens are summed.
BLOCK = 2048
MOST_REPEATS = 4.0
#: Exponents evaluated by one aggregate, and rounds of it: 128**6 steps from 0 to 1.
STEPS, ROUNDS = 128, 6
#: Bits of a key, and bits of keys told apart by one running sum.
KEY_BITS, LEVEL_BITS = 53, 12


def source_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows id, source, n_tokens; sources with tokens and docs)."""
    sized = materialise(docs.select(column(id_col).alias("id"), column(source_col).alias("source"), F.coalesce(F.regexp_count(column(text_col), F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens")))
    return sized, materialise(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))


def exponent(sources: DataFrame, target_entropy: float | None = None, most_repeats: float = MOST_REPEATS, budget_share: float | None = None) -> float:
    """The least exponent from 0 to 1 whose weights have at most the target entropy and keep every source within the limit of repeats.

    sources has tokens.  By default the target lies halfway between the shares' entropy
    and the largest.  Without a budget (in corpora) every source passes at least once.
    """
    counted = sources.where("tokens > 0").select(F.col("tokens").cast("double"))
    n, total, least, largest = counted.agg(F.count("*"), F.sum("tokens"), F.min("tokens"), F.max("tokens")).head()
    if n < 2:
        return 1.0
    share = F.col("tokens") / total

    def evaluated(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(exponent, entropy, most repeats) of each."""
        each = counted.select(share.alias("s"), F.explode(F.array(*map(F.lit, exponents))).alias("e"))
        raised = F.pow("s", F.col("e"))
        out = []
        for e, z, logs in each.groupBy("e").agg(F.sum(raised), F.sum(raised * F.log("s"))).collect():
            # The rarest source repeats most, the largest one least.
            repeats = (largest / least) ** (1 - e) if budget_share is None else budget_share * (least / total) ** (e - 1) / z
            out.append((e, math.log(z) - e * logs / z, repeats))
        return sorted(out)

    if target_entropy is None:
        target_entropy = (evaluated([1.0])[0][1] + math.log(n)) / 2
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = evaluated([lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)])
        # Both conditions stay true upwards.
        fit = next((i for i, (_, h, r) in enumerate(tried) if h <= target_entropy + 1e-12 and r <= most_repeats * (1 + 1e-12)), STEPS)
        if fit == 0:
            return tried[0][0]
        lo, hi = tried[fit - 1][0], tried[fit][0]
    return hi


def _key(seed: int, epoch: Column, id_: Column) -> Column:
    """A document's place in an epoch's permutation, KEY_BITS bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), id_.cast("string")), 64 - KEY_BITS)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_tokens: int | None = None, target_entropy: float | None = None, most_repeats: float = MOST_REPEATS, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """(rows id, source and n_tokens; cuts by source; number of blocks): what realises the weights.

    A cut has weight, repeats, full (whole epochs), rest (tokens of one more) and the key up to which that one goes.
    """
    sized, sources = source_totals(docs, id_col, text_col, source_col)
    total, largest, most_docs = sources.agg(F.sum("tokens"), F.max("tokens"), F.max("docs")).head()
    total, budget = max(1, total or 0), None if budget_tokens is None else budget_tokens / max(1, total or 0)
    e = exponent(sources, target_entropy, most_repeats, budget)
    share = F.col("tokens") / F.lit(float(total))
    raised = F.when(F.col("tokens") > 0, F.pow(share, F.lit(e))).otherwise(0.0)
    z = sources.agg(F.sum(raised)).head()[0] or 1.0
    # Passes of a source: its weight over its share, times the budget; without one, the largest source passes once.
    times = F.pow(F.col("tokens") / F.lit(float(largest or 1)), F.lit(e - 1)) if budget is None else F.lit(budget / z) * F.pow(share, F.lit(e - 1))
    wanted = sources.select("source", "tokens", "docs", (raised / z).alias("weight"), F.when(F.col("tokens") > 0, times).otherwise(1.0).alias("repeats"))
    wanted = wanted.withColumn("full", F.floor(F.col("repeats") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), F.col("repeats") - F.col("full")) * F.col("tokens"))
    wanted = materialise(wanted)
    passes = wanted.agg(F.sum(F.col("repeats") * F.col("docs"))).head()[0] or 0.0

    # The cut: the group of keys in which the running sum of tokens passes the rest, then the key in that group.
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, most_docs or 1) / BLOCK))))
    keyed = _beside(sized, wanted.where("rest > 0").select("source", "full", "rest")).select("source", "n_tokens", _key(seed, F.col("full"), F.col("id")).alias("k"))
    groups = materialise(keyed.groupBy("source", F.shiftrightunsigned("k", KEY_BITS - bits).alias("group")).agg(F.sum("n_tokens").alias("own")))
    edge, known = wanted.where("rest > 0").select("source", F.lit(0).cast("long").alias("cut"), F.col("rest").alias("left")), 0
    upto = F.sum("own").over(W.partitionBy("source").orderBy("group"))
    while known < bits or known == 0:
        level = min(bits, known + LEVEL_BITS)
        inside = _beside(groups, edge).where(F.shiftrightunsigned("group", bits - known) == F.col("cut"))
        inside = inside.groupBy("source", F.shiftrightunsigned("group", bits - level).alias("group")).agg(F.sum("own").alias("own"), F.first("left").alias("left")).withColumn("upto", upto)
        edge = inside.where("upto > left").groupBy("source").agg(F.min(F.struct(F.col("group").alias("cut"), (F.col("left") - F.col("upto") + F.col("own")).alias("left"))).alias("e")).select("source", "e.cut", "e.left")
        edge, known = materialise(edge), level
        if not bits:
            break
    inside = _beside(keyed, edge).where(F.shiftrightunsigned("k", KEY_BITS - bits) == F.col("cut"))
    running = F.sum("n_tokens").over(W.partitionBy("source").orderBy("k").rangeBetween(W.unboundedPreceding, W.currentRow))
    last = inside.withColumn("upto", running).where("upto <= left").groupBy("source").agg(F.max("k").alias("last"))
    # Without an edge the rest holds the whole epoch; without a key in the edge's group it ends before that group.
    before = F.shiftleft("cut", KEY_BITS - bits) - 1
    ends = edge.select(F.col("source").alias("s"), "cut").join(last.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("last", before).alias("end"))
    cuts = wanted.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    all_keys = F.lit((1 << KEY_BITS) - 1)
    cuts = cuts.select("source", "weight", "repeats", "full", "rest", F.when(F.col("rest") > 0, F.coalesce("end", all_keys)).otherwise(F.lit(-1).cast("long")).alias("end"))
    return sized, materialise(cuts), max(1, round(passes / BLOCK))


def _beside(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with their source's columns, which are broadcast if few."""
    by_source = broadcast_if_small(by_source).withColumnRenamed("source", "of")
    return rows.join(by_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _passed(rows: DataFrame, cuts: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Rows with id and source, one for each pass: adds times, epoch, block and place."""
    rows = _beside(rows, cuts.select("source", "repeats", "full", "end"))
    rows = rows.withColumn("times", F.col("full") + F.when(_key(seed, F.col("full"), F.col("id")) <= F.col("end"), 1).otherwise(0)).where("times > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    come = F.col("epoch") + _key(seed, F.col("epoch"), F.col("id")) / float(1 << KEY_BITS)
    # A rest of less than a key's step may lie past the end.
    place = F.least(come / F.greatest(F.col("repeats"), F.lit(1e-300)), F.lit(1.0))
    return rows.withColumn("place", place).withColumn("block", F.least(F.floor(F.col("place") * blocks), F.lit(blocks - 1)).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **targets: object) -> DataFrame:
    """A row for each pass of a document: id, source, n_tokens, repeats, epoch, block and place (order by block, place and id)."""
    sized, cuts, blocks = plan(docs, id_col, text_col, source_col, seed=seed, **targets)
    passed = _passed(sized, cuts, blocks, seed)
    return passed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", F.col("times").alias("repeats"), "epoch", "block", "place")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **targets: object) -> DataFrame:
    """The rows themselves, each as often as the mixture passes it."""
    _, cuts, blocks = plan(docs, id_col, text_col, source_col, seed=seed, **targets)
    # The rows' own columns travel in one struct, so that no name of theirs meets one of these.
    own = docs.select(F.struct(*map(column, docs.columns)).alias("own")).select("own", column("own", id_col).alias("id"), column("own", source_col).alias("source"))
    return _passed(own, cuts, blocks, seed).select(*[column("own", c).alias(c) for c in docs.columns])
