"""I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits in lower case.  A term stays in the lexicon if
its inverse document frequency over the whole corpus lies in a chosen band.  A
fingerprint hashes the sorted distinct lexicon terms of a text under the whole
lexicon and under several randomised subsets of it.  Subsets keep a term with
probabilities from 1/16 down to 1/4096, so texts of any length have subsets that
take a few of their terms only and survive edits elsewhere.

Document frequencies are counted term by term over all documents, by 64-bit hash.
The terms in the band go to every task as a literal, a Bloom filter.  It has ``BITS_A_TERM`` bits
for each counted term of the band, so it grows with the lexicon and its error doesn't:
no term of the band is lost, and one outside it comes in with a probability of about
0.7 %, whatever the corpus.

Defined results: a null text is an empty one; a text without lexicon terms has its
own hash in the first place and nothing in the others; equal texts have equal
fingerprints; repeated rows count once each; the neighbour order breaks ties of ids
by text and puts null ids last, by a hash of their text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrow import broadcast_if_small, column, materialise

#: Bits of the filter for each term of the band.
BITS_A_TERM = 24
#: The band: terms of at least so many documents and at most such a share of them.
LEAST_DOCUMENTS = 2
MOST_SHARE = 0.2
#: Randomised subsets: for each seed, nested ones that keep a term with probability 2**-bits.
SEEDS, BITS = 6, tuple(range(4, 13))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))


def _places(term: Column, bits: int) -> list[Column]:
    """The places of a term's two bits in a filter of so many bits."""
    return [F.pmod(hashed, F.lit(bits).cast("long")) for hashed in (term, F.xxhash64(term))]


def _within(term: Column, held: Column, bits: int) -> Column:
    """Whether a filter holds a term: its bits are set in bytes of seven bits each, which are ASCII."""

    def probed(place: Column) -> Column:
        byte = F.ascii(F.substring(held, (F.call_function("div", place, F.lit(7)) + 1).cast("int"), F.lit(1)).cast("string"))
        return F.call_function("shiftright", byte, (place % 7).cast("int")).bitwiseAND(F.lit(1)) == 1

    first, second = map(probed, _places(term, bits))
    return first & second


def lexicon(docs: DataFrame, text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, most_share: float = MOST_SHARE) -> bytes:
    """The terms whose document frequency is in the band, as a Bloom filter."""
    # A null in each text counts the documents.
    found = docs.select(F.explode(F.concat(terms(column(text_col)), F.array(F.lit(None).cast("long")))).alias("term"))
    counted = materialise(found.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") >= least_documents) | F.col("term").isNull()))
    documents = (counted.where("term is null").select("n").head() or [0])[0]
    within = counted.where(F.col("term").isNotNull() & (F.col("n") >= least_documents) & (F.col("n") <= max(least_documents, math.floor(most_share * documents))))
    words = max(1, -(-within.count() * BITS_A_TERM // 56))  # of eight bytes each
    places = within.select(F.explode(F.array(*_places(F.col("term"), 56 * words))).alias("place"))
    bit = (F.expr("place % 56 div 7") * 8 + F.col("place") % 7).cast("int")
    rows = places.groupBy(F.expr("place div 56").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(words, "<i8")
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def fingerprint(text: Column, kept: bytes) -> Column:
    """The fingerprint of a text: a hash for each subset, null where the text has none of its terms."""
    # Bound once: a plan prints the literal wherever it stands.
    own = F.array_sort(F.transform(F.array(F.lit(kept)), lambda held: F.filter(terms(text), lambda t: _within(t, held, 7 * len(kept))))[0])

    def hashed(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.xxhash64(terms))

    def subset(terms: Column, seed: int, bits: int) -> Column:
        return F.filter(terms, lambda t: F.shiftrightunsigned(t, 10 * seed).bitwiseAND(F.lit((1 << bits) - 1)) == 0)

    def nested(own: Column, seed: int) -> Column:
        largest = F.array(subset(own, seed, BITS[0]))
        return F.transform(largest, lambda t: F.array(*[hashed(subset(t, seed, bits)) for bits in BITS]))[0]

    def hashes(own: Column) -> Column:
        whole = F.coalesce(hashed(own), F.xxhash64(F.coalesce(text, F.lit(""))))
        return F.concat(F.array(whole), *[nested(own, seed) for seed in range(SEEDS)])

    return F.transform(F.array(own), hashes)[0]


def fingerprint_string(hashes: Column) -> Column:
    """16 hex digits for each subset, ``-`` for one without terms."""
    return F.array_join(F.transform(hashes, lambda h: F.when(h.isNull(), F.lit("-")).otherwise(F.lpad(F.lower(F.hex(h)), 16, "0"))), ".")


def likeness(x: Column, y: Column) -> Column:
    """Share of the subsets that hash terms of either text in which both hash alike."""
    both = F.zip_with(x, y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    used = F.size(F.filter(both, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(both, lambda p: p["a"] == p["b"]))
    return same / used


#: Ids of one cell of neighbours, about: the bound of what one task sorts.
CELL = 4096


def _come(key: Column, lo: Column) -> Column:
    """How far a key lies over another one."""
    return (key.cast("decimal(20,0)") - lo.cast("decimal(20,0)")).cast("double")


def _dealt(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows with named and key, and the cell of each: an array that orders cells as it orders keys."""
    rows = rows.withColumn("cell", F.array(F.col("named").cast("double")))
    for level in levels:
        split = level.toDF("of", "lo", "width")
        rows = rows.join(split, F.col("cell") == F.col("of"), "left")
        within = F.coalesce(F.floor(_come(F.col("key"), F.col("lo")) / F.col("width")).cast("double"), F.lit(0.0))
        rows = rows.withColumn("cell", F.concat("cell", F.array(within))).drop("of", "lo", "width")
    return rows


def _levels(keys: DataFrame) -> list[DataFrame]:
    """Tables (cell, lo, width) of the cells to split, level by level, until none holds many more than CELL different keys.

    Cells are split into equal widths between their own ends, so a far-off key costs a level and not a large cell.
    """
    levels: list[DataFrame] = []
    while True:
        found = _dealt(keys, levels).groupBy("cell").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where((F.col("n") > 4 * CELL) & (F.col("lo") < F.col("hi")))
        found = materialise(found.select("cell", "lo", (_come(F.col("hi"), F.col("lo")) * CELL / F.col("n")).alias("width")))
        if found.isEmpty():
            return levels
        levels.append(broadcast_if_small(found))


def _heads(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (named, key, before): the first key of each cell in descending order, and the cell that comes before."""
    heads = materialise(_dealt(keys, levels).groupBy("cell", "named").agg(F.max("key").alias("key")))
    if heads.count() <= 4 * CELL:
        over = W.partitionBy(F.lit(0))
        before = F.coalesce(F.lag("cell").over(over.orderBy(F.col("cell").desc())), F.min("cell").over(over))
        return heads.select("named", "key", before.alias("before"))
    # Cells of heads are dealt out as keys are.
    above = _levels(heads.select("named", "key"))
    dealt = _dealt(heads.withColumnRenamed("cell", "own"), above)
    inside = dealt.withColumn("before", F.lag("own").over(W.partitionBy("cell").orderBy(F.col("key").desc())))
    ends = dealt.groupBy("cell").agg(F.min_by("own", "key").alias("last"))
    firsts = _heads(heads.select("named", "key"), above).join(ends.select(F.col("cell").alias("before"), "last"), "before").select(F.col("named").alias("n"), F.col("key").alias("k"), "last")
    inside = inside.join(firsts, (F.col("named") == F.col("n")) & (F.col("key") == F.col("k")), "left")
    return materialise(inside.select("named", "key", F.coalesce("before", "last").alias("before")))


def with_next(docs: DataFrame, value: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, value, next_value): the value, of its text, of the next row in descending order of ids; after the last comes the first.

    Cells of neighbouring ids are sorted each for itself.  Only their ends meet the
    next cell's first row, found through a table CELL times smaller than the input.
    """
    id_, text = column(id_col).cast("long"), F.coalesce(column(text_col), F.lit(""))
    unnamed = not docs.where(id_.isNull()).isEmpty()
    rows = docs.select(id_.isNotNull().alias("named"), (F.coalesce(id_, F.xxhash64(text)) if unnamed else id_).alias("key"), text.alias("text"))
    keys = rows.select("named", "key")
    levels = _levels(keys)
    # The heads' documents first, their values then.
    first = rows.join(broadcast_if_small(_heads(keys, levels)), ["named", "key"]).groupBy("before").agg(F.min("text").alias("text"))
    first = broadcast_if_small(first.select("before", value(F.col("text")).alias("first")))
    rows = _dealt(rows.withColumn("value", value(F.col("text"))), levels)
    rows = rows.withColumn("next", F.lead("value").over(W.partitionBy("cell").orderBy(F.col("key").desc(), "text")))
    rows = rows.join(first, (F.col("cell") == F.col("before")) & F.col("next").isNull(), "left")
    return rows.select(F.when(F.col("named"), F.col("key")).alias(id_col), "value", F.coalesce("next", "first").alias("next_value"))
