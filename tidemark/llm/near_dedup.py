"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document's set of distinct word shingles gets a MinHash signature of ``COORDINATES``
values.  Documents are posted under each coordinate-value pair, collisions are counted,
and pairs that collide in ``MATCHES`` coordinates or more are confirmed on the full sets
of 64-bit shingle hashes.  Links are closed to components.  Steps end in checkpoints,
whose shuffle files go at once and which hold few documents in few partitions.

Lists are merged with prefix and skip.  A document's pairs are put in order, the rarest
first; two documents that collide ``MATCHES`` times share a list among the first
``COORDINATES - MATCHES + 1`` of each, so only these are merged, and the ``MATCHES - 1``
longest lists of each document are skipped.  Documents with fewer than ``MATCHES`` shared
pairs are out.  Pairs that the merged lists don't settle look the skipped coordinates up
in both signatures before their sets are compared.

No pairs are listed within a group of copies.  Equal sets are one representative.  The
hub of a merged list is the document that meets the most others over all its lists (the
least edited of a group of near copies).  Each document is first a candidate of the one
hub with which it collides most; then, in lists that are still in several components, of
the hubs of other components, n-1 candidates at most in a list of n documents.  What that
leaves in different components meets once more:

* in lists of up to ``LIST`` documents each with each, a number of pairs in
  proportion to the postings;
* in longer lists only documents whose sets can still overlap enough.  A pair's
  overlap is at most what both share with the hub, plus their frequent other
  shingles, plus the rare ones that they share, a rare one being held by at most
  ``RARE`` of the hub's documents.  Pairs that share a rare shingle are compared.  Of
  the others, documents with the same shingles but for rare ones are a class, as are
  pages of a template with the same sections.  Its head is the one with the fewest
  rare shingles: who isn't similar to a head, isn't similar to any of the class
  without sharing a rare shingle.  So documents meet the head of their class, heads
  meet heads, and the classes of two similar heads meet the other's head.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and is its own component; a text of fewer words than a shingle has one
shingle, the whole; repeated rows share a component and all stay or go together; ties
go to the least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, broadcast_if_small, detached, few_parts, releasing, shuffles_removed
from ._components import connected_components
from ._words import gram_hashes, mix64, words_of

SHINGLE = 5
PERCENT = 80
#: Coordinates of a signature, and collisions from which a pair is confirmed: one of similarity 0.8 has fewer with probability 1e-9.
COORDINATES, MATCHES = 40, 15
LIST, RARE = 32, 16

_U = np.uint64
_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=_U) << _U(8))
_MULTIPLIERS = mix64(_SEEDS) | _U(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = words_of(texts, lower=True)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield np.unique(gram_hashes(words.hash[a:b], min(size, b - a))) if b > a else np.zeros(0, _U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinate-value pairs of a non-empty set, each as one 64-bit key."""
    least = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
        return mix64(least ^ _SEEDS).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, keys = [], [], []
            for shingles in shingle_sets(batch.column(1), size):
                counts.append(len(shingles))
                names.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                keys.append(signature(shingles).tolist() if len(shingles) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_name", "keys"])

    return docs.mapInArrow(releasing(rows), "doc_id long, n_shingles long, set_name binary, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, size: int, n: int) -> DataFrame:
    """Rows (doc_id, packed): the signatures and, after them, the sets of some documents."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [signature(s).tobytes() + s.tobytes() for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    found = docs.join(broadcast_if_small(few_parts(ids.distinct(), n)), "doc_id", "left_semi").mapInArrow(releasing(sets), "doc_id long, packed binary")
    return detached(found.dropDuplicates(["doc_id"]), n)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (hub, doc_id, members, …) with what is packed of both beside them, as x and y.

    A hub of many members is sent in several parts, about the root of their number, so that no task has all of its pairs.
    """
    parts = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.sqrt("members") / 8)))
    # Merge joins, so that the sets and what comes of them are made in stages, and workers, of their own.
    hubs = parts.select("hub", "part").distinct().join(sets.select(F.col("doc_id").alias("hub"), F.col("packed").alias("x")).hint("merge"), "hub")
    return parts.join(hubs.hint("merge"), ["hub", "part"]).drop("part").join(sets.select("doc_id", F.col("packed").alias("y")).hint("merge"), "doc_id")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of pairs (hub, doc_id, matches, members): those of enough collisions that are similar enough on their full sets.

    matches counts the collisions in the merged lists; where they aren't enough, the skipped ones are looked up in both signatures.
    """

    def linked(x: np.ndarray, y: np.ndarray, matches: int) -> bool:
        if matches < MATCHES and int((x[:COORDINATES] == y[:COORDINATES]).sum()) < MATCHES:
            return False
        both = np.concatenate((x[COORDINATES:], y[COORDINATES:]))
        both.sort(kind="stable")
        n = int((both[1:] == both[:-1]).sum())
        return 100 * n >= percent * (len(both) - n)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = pa.array([linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), m) for x, y, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), batch.column(1).filter(same)], names=["a", "b"])

    n = sets.count()
    pairs = detached(pairs.groupBy("hub", "doc_id").agg(F.sum("matches").alias("matches"), F.max("members").alias("members")), n)
    met = _beside(pairs, sets).select("hub", "doc_id", "x", "y", "matches")
    # Few pairs are found among the sets of all documents, so that these bound the partitions, too.
    return detached(met.mapInArrow(releasing(compared), "a long, b long"), max(n, pairs.count()))


def _sizes(x: F.Column, y: F.Column, percent: int) -> F.Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _pairs_of(x: DataFrame, y: DataFrame, on: str, more: F.Column) -> DataFrame:
    """Rows (hub, doc_id) from x and y, aliased so, that agree on a column and satisfy a condition."""
    return x.join(y, (F.col(f"x.{on}") == F.col(f"y.{on}")) & more).select(F.least("x.doc_id", "y.doc_id").alias("hub"), F.greatest("x.doc_id", "y.doc_id").alias("doc_id"))


def _posted(single: DataFrame, n: int) -> DataFrame:
    """Rows (key, members, doc_id, n_shingles, hub, met): the lists to merge, without those of one document; met is the hub's."""
    postings = single.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    # What is counted by list is written before it meets the postings: only a join of plain exchanges deals a long list over several tasks.
    shared = postings.join(detached(postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), n), "key")
    # A document holds at most COORDINATES keys; those of no other document come before the shared ones.
    own = shared.groupBy("doc_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("members", "key"))).alias("lists")).where(F.size("lists") >= MATCHES)
    prefix = own.select("doc_id", "n_shingles", F.explode(F.slice("lists", F.lit(1), F.size("lists") - (MATCHES - 1))["key"]).alias("key"))
    prefix = detached(prefix, n)
    posted = detached(prefix.join(detached(prefix.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), n), "key"), n)
    posted = posted.join(posted.groupBy("doc_id").agg(F.sum("members").alias("met")), "doc_id")
    hubs = posted.groupBy("key").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("least"))).alias("of")).select("key", (-F.col("of.least")).alias("hub"), "of.met")
    return detached(posted.drop("met").join(detached(hubs, n), "key"), n)


def _in_components(posted: DataFrame, components: DataFrame, n: int) -> DataFrame:
    """Rows (key, members, doc_id, n_shingles, hub, component, of_hub) of the lists that lie in several components, without their hubs."""
    rows = posted.drop("met").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("doc_id") == F.col("hub"), F.col("component"))).alias("of_hub")).where("lo < hi").select("key", "of_hub")
    return detached(rows.join(detached(split, n), "key").where("doc_id <> hub"), n)


def _left_over(rows: DataFrame, sets: DataFrame, percent: int, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, links): pairs (hub, doc_id, matches, members) that share merged lists, lie in different components and can be similar enough; links of heads."""
    rows = rows.where("members > 2")
    sizes = _sizes(F.col("x.n_shingles"), F.col("y.n_shingles"), percent)

    short = rows.where(F.col("members") <= LIST)
    within = (F.col("x.component") < F.col("y.component")) & sizes
    pairs = _pairs_of(short.alias("x"), short.alias("y"), "key", within).select("hub", "doc_id", F.lit(1).alias("matches"), F.lit(LIST).alias("members"))

    group = detached(rows.where(F.col("members") > LIST).groupBy("hub", "doc_id").agg(F.first("n_shingles").alias("n_shingles"), F.first("component").alias("component"), F.max("members").alias("members"), F.first("of_hub").alias("of_hub")), n)
    if group.isEmpty():
        return pairs, None

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_of = [(np.frombuffer(x.as_buffer(), _U)[COORDINATES:], np.frombuffer(y.as_buffer(), _U)[COORDINATES:]) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            found = [np.setdiff1d(y, x, assume_unique=True).view(np.int64) for x, y in sets_of]
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            whole = np.array([np.bitwise_xor.reduce(y) for _, y in sets_of], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))), pa.array(whole)], names=["hub", "doc_id", "others", "whole"])

    other = _beside(group.select("hub", "doc_id", "members"), sets).select("hub", "doc_id", "x", "y").mapInArrow(releasing(others), "hub long, doc_id long, others array<long>, whole long")
    other = detached(other, n)
    # Rows of shingles, far more than documents, keep the session's partitions.
    shared = other.select("hub", "doc_id", F.size("others").alias("own"), "whole")
    other = detached(other.repartition("hub", "doc_id").select("hub", "doc_id", F.explode("others").alias("shingle")))
    often = detached(other.groupBy("hub", "shingle").agg(F.count("*").alias("docs"), F.min("doc_id").alias("doc_id")).where(F.col("docs") <= RARE))
    rare = detached(other.join(often.where("docs > 1").select("hub", "shingle"), ["hub", "shingle"]))
    counts = often.where("docs = 1").select("hub", "doc_id", "shingle").unionAll(rare.select("hub", "doc_id", "shingle")).groupBy("hub", "doc_id").agg(F.count("*").alias("rare"), F.expr("bit_xor(shingle)").alias("apart"))
    group = group.join(shared, ["hub", "doc_id"]).join(counts, ["hub", "doc_id"], "left")
    # What a document shares with the hub, what it can share with another one besides that and rare shingles, and its class, both together.
    group = group.withColumn("shared", F.col("n_shingles") - F.col("own")).withColumn("frequent", F.col("own") - F.coalesce("rare", F.lit(0)))
    group = detached(group.withColumn("class", F.struct("shared", "frequent", F.col("whole").bitwiseXOR(F.coalesce("apart", F.lit(0))).alias("name"))).drop("rare", "own", "whole", "apart"), n)
    enough = lambda extra: (100 + percent) * (F.least("x.shared", "y.shared") + F.least("x.frequent", "y.frequent") + extra) >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles"))

    # A partner has at least percent of a document's shingles.
    able = group.where(100 * (F.col("shared") + F.col("frequent")) >= percent * F.col("n_shingles")).withColumn("outside", F.col("component") != F.col("of_hub"))
    head = F.min(F.struct("n_shingles", "doc_id", "component")).alias("h")
    heads = able.groupBy("hub", "class").agg(head, F.max("outside").alias("outside"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    heads = detached(heads.select("hub", "class", "class.shared", "class.frequent", "h.*", "outside", "lo", "hi"), n)
    within = able.alias("x").join(heads.alias("y"), ["hub", "class"]).where((F.col("x.component") != F.col("y.component")) & sizes & enough(F.lit(0)))
    met = within.select(F.least("x.doc_id", "y.doc_id").alias("hub"), F.greatest("x.doc_id", "y.doc_id").alias("doc_id"))
    both_in_one = (F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo"))
    apart = ~both_in_one & (~F.col("y.outside") | (F.col("x.class") < F.col("y.class"))) & (F.col("x.class") != F.col("y.class")) & sizes & enough(F.lit(0))
    x, y = heads.where("outside").alias("x"), heads.alias("y")
    of_heads = x.join(y, (F.col("x.hub") == F.col("y.hub")) & apart).select(F.col("x.hub").alias("of"), F.col("x.class").alias("one"), F.col("y.class").alias("two"), F.least("x.doc_id", "y.doc_id").alias("hub"), F.greatest("x.doc_id", "y.doc_id").alias("doc_id"))
    of_heads = detached(of_heads, n)
    similar = _links(of_heads.select("hub", "doc_id", F.lit(0).alias("matches"), F.lit(LIST * LIST).alias("members")).distinct(), sets, percent)
    alike = of_heads.join(similar.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")), ["hub", "doc_id"])
    either = alike.select("of", F.col("one").alias("class"), F.col("two").alias("to")).unionAll(alike.select("of", F.col("two").alias("class"), F.col("one").alias("to")))
    either = either.join(heads.select(F.col("hub").alias("of"), F.col("class").alias("to"), F.col("doc_id").alias("at"), F.col("component").alias("of_at")), ["of", "to"])
    crossing = able.withColumnRenamed("hub", "of").join(either, ["of", "class"]).where("component <> of_at").select(F.least("doc_id", "at").alias("hub"), F.greatest("doc_id", "at").alias("doc_id"))
    met = met.unionAll(crossing)

    named = rare.join(group, ["hub", "doc_id"])
    x, y = named.alias("x"), named.alias("y")
    both = ["n_shingles", "shared", "frequent"]
    found = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & sizes)
    found = found.groupBy(F.col("x.hub").alias("at"), F.col("x.doc_id").alias("xd"), F.col("y.doc_id").alias("yd")).agg(F.count("*").alias("n"), *[F.first(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in both])
    overlap = F.least("x_shared", "y_shared") + F.least("x_frequent", "y_frequent") + F.col("n")
    found = found.where((100 + percent) * overlap >= percent * (F.col("x_n_shingles") + F.col("y_n_shingles")))
    met = met.unionAll(found.select(F.least("xd", "yd").alias("hub"), F.greatest("xd", "yd").alias("doc_id"))).distinct()
    return pairs.unionAll(met.select("hub", "doc_id", F.lit(0).alias("matches"), F.lit(LIST * LIST).alias("members"))), similar


def _in_groups(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, least, components): documents with the names of their sets, the least document of each set, components of those that are linked."""
    signed = detached(_signed(docs, shingle))
    n = signed.count()
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    least = filled.groupBy("set_name").agg(F.min("doc_id").alias("doc_id"))
    single = detached(filled.join(least, ["set_name", "doc_id"], "left_semi").dropDuplicates(["set_name", "doc_id"]).select("doc_id", "n_shingles", "keys"), n)
    posted = _posted(single, n)
    sets = _sets(docs, posted.select("doc_id"), shingle, n)
    matches = posted.where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("matches"), F.max("members").alias("members"), F.first("met").alias("met"))
    best = matches.groupBy("doc_id").agg(F.max(F.struct("matches", "met", (-F.col("hub")).alias("hub"), "members")).alias("b"))
    links = _links(best.select((-F.col("b.hub")).alias("hub"), "doc_id", "b.matches", "b.members"), sets, percent)
    components = connected_components(links, n)
    rows = _in_components(posted, components, n)
    others = _links(rows.where("component <> of_hub").select("hub", "doc_id", F.lit(1).alias("matches"), "members"), sets, percent)
    if not others.isEmpty():
        links = links.unionAll(others)
        components = connected_components(links, n)
        rows = _in_components(posted, components, n)
    pairs, similar = _left_over(rows, sets, percent, n)
    rest = _links(pairs, sets, percent)
    rest = rest if similar is None else rest.unionAll(similar)
    if not rest.isEmpty():
        components = connected_components(links.unionAll(rest), n)
    return signed, least, components


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept).

    Documents with 100 * intersection >= percent * union are linked; component_id is
    the least id that links reach, kept holds for that document.  Ids must be
    distinct for different texts; a row without an id is linked with nothing and kept.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with shuffles_removed(docs.sparkSession):
        signed, least, components = _in_groups(docs, shingle, percent)

    found = components.withColumnRenamed("node", "least")
    of_set = least.select("set_name", F.col("doc_id").alias("least")).join(found, "least", "left").select("set_name", F.coalesce("component", "least").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_name").join(of_set, "set_name", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
