"""Phrase collocations by word-id suffix arrays of shards.

A task gathers the texts of a language into shards of bounded size.  A shard's words are
numbered, and prefix doubling sorts all its suffixes by their first four words: ranks of
one word give ranks of two, those give ranks of four.  Neighbours in that order share a
prefix of so many words; for each n the intervals that share n words are the shard's
n-grams with their counts.  Shards' counts are merged by language and phrase.

That is done twice.  The first pass counts words and pairs.  A phrase is no more frequent
than any pair in it, so the second pass sends only those of three and four words whose
pairs are all frequent.  It knows these by a sorted array of hashes, that is broadcast up
to ``FILTER_PAIRS`` pairs; beyond that all are sent, with the same result.

Defined results: a null text is an empty one, a null language is ``und``; rows are
documents for themselves, repeated or without an id; an empty table gives an empty
result; other columns are ignored.  A shard is cut between pieces, so a task's memory is
bounded but for a single piece that is longer than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import bounded_batches, column, materialise, releasing
from ._words import mix64

LEAST, TOP, LONGEST = 30, 2000, 4
#: Bytes of text in a shard, about; rows of a batch that leaves it; pairs known to the second pass.
SHARD_BYTES, SENT_ROWS = 6 << 20, 20_000
FILTER_PAIRS = 2_000_000

_U = np.uint64
_KIND = np.zeros(256, np.uint8)  # of a byte: 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", np.uint8)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shard:
    """Words of some texts, as numbers, and their suffixes in order.

    words: the number of each word plus one, with a zero after each piece and four more
    at the end; suffixes: places of words, sorted by the next four; shared: words that a
    suffix shares with the one before it.
    """

    def __init__(self, raw: np.ndarray):
        """raw: bytes of texts, each followed by a byte that ends a piece."""
        kind = _KIND[raw]
        word = kind == 0
        before = np.append(False, word[:-1])
        begins, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
        if len(ends) < len(begins):
            ends = np.append(ends, len(raw))
        offsets = pa.py_buffer(np.append(0, np.cumsum(ends - begins)))
        coded = pa.LargeStringArray.from_buffers(len(begins), offsets, pa.py_buffer(_LOWER[raw[word]])).dictionary_encode()
        del word, before, ends, offsets
        self.texts: pa.Array = coded.dictionary
        numbers = coded.indices.to_numpy().astype(np.int64) + 1
        # A word's place moves on by the pieces that have ended before it.
        stops = np.flatnonzero(kind == 2)
        piece = np.searchsorted(stops, begins)
        gap = np.append(0, np.cumsum(piece[1:] != piece[:-1])) if len(begins) else piece
        self.words = np.zeros(len(begins) + (int(gap[-1]) if len(gap) else 0) + LONGEST + 1, np.int64)
        places = np.arange(len(begins)) + gap
        self.words[places] = numbers
        self._sort(places)

    def _sort(self, places: np.ndarray) -> None:
        words, top = self.words, len(self.words) + 1
        second = np.append(words[1:], 0)
        two = np.zeros(len(words) + 2, np.int64)
        pairs = words[places] * top + second[places]
        order = np.argsort(pairs)
        ordered = pairs[order]
        two[places[order]] = 1 + np.cumsum(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        del pairs, order, ordered
        # Past the end of a piece nothing follows.
        four = two[places] * top + np.where(second[places] > 0, two[places + 2], 0)
        self.suffixes = places[np.argsort(four)]
        del two, four
        here, there = self.suffixes[1:], self.suffixes[:-1]
        same, self.shared = np.ones(len(here), bool), np.zeros(len(self.suffixes), np.int64)
        for k in range(LONGEST):
            same &= (words[here + k] == words[there + k]) & (words[here + k] > 0)
            self.shared[1:] += same

    def whole(self, n: int) -> np.ndarray:
        """Which suffixes have n words before their piece ends."""
        ok = np.ones(len(self.suffixes), bool)
        for k in range(1, n):
            ok &= self.words[self.suffixes + k] > 0
        return ok

    def intervals(self, n: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of each n-gram among the suffixes ``ok``, all of an n-gram's or none."""
        at = np.flatnonzero(ok)
        first = np.flatnonzero(self.shared[at] < n)
        return self.suffixes[at[first]], np.diff(np.append(first, len(at)))

    def phrases(self, places: np.ndarray, n: int) -> pa.Array:
        words = [self.texts.take(pa.array(self.words[places + k] - 1)) for k in range(n)]
        return (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if n > 1 else words[0]).cast(pa.string())


def _hash(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, _U)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets, base = offsets - offsets[0], 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(raw) + 1, base, _U), dtype=_U)
        down = np.cumprod(np.full(len(raw) + 1, pow(base, -1, 1 << 64), _U), dtype=_U)
        total = np.append(_U(0), np.cumsum(mix64(raw.astype(_U) + _U(1)) * up[:-1], dtype=_U))
        return mix64((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]] + np.diff(offsets).astype(_U))


def _pair_hashes(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(first * _U(0x9E3779B97F4A7C15) + second * _U(0xC2B2AE3D27D4EB4F) + _hash(pa.array([lang]))[0])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(language, bytes) of shards; columns of the batches are the language and the text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, np.ndarray]]:
        raw = np.frombuffer(b"\n".join([*held.pop(lang), b""]), np.uint8)
        size.pop(lang)
        while len(raw) > 2 * SHARD_BYTES and len(stops := np.flatnonzero(_KIND[raw[SHARD_BYTES:]] == 2)):
            yield lang, raw[: SHARD_BYTES + stops[0] + 1]
            raw = raw[SHARD_BYTES + stops[0] + 1 :]
        yield lang, raw

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            held.setdefault(lang, []).append(raw)
            size[lang] = size.get(lang, 0) + len(raw) + 1
            if size[lang] >= SHARD_BYTES:
                yield from cut(lang)
            elif sum(size.values()) >= 2 * SHARD_BYTES:  # many languages, none of them full
                yield from cut(max(size, key=size.get))
    for lang in list(held):
        yield from cut(lang)


COUNTS = "lang string, phrase string, a long"


def _rows(lang: str, shard: Shard, n: int, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
    places, counts = shard.intervals(n, ok)
    for i in range(0, len(counts), SENT_ROWS):
        phrases = shard.phrases(places[i : i + SENT_ROWS], n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), phrases, pa.array(counts[i : i + SENT_ROWS], pa.int64())], names=["lang", "phrase", "a"])


def _merged(docs: DataFrame, counted, least: int) -> DataFrame:
    rows = docs.mapInArrow(releasing(counted), COUNTS).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return materialise(rows.where((F.col("a") >= least) | (F.col("phrase") == "")))


def phrase_counts(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, phrase, a): phrases of one to four words that occur at least ``least`` times, and '' with all words of a language."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).cast("string").alias("text")).where("text is not null")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in _shards(batches):
            shard = Shard(raw)
            if len(shard.suffixes):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([len(shard.suffixes)])], names=["lang", "phrase", "a"])
            for n in (1, 2):
                yield from _rows(lang, shard, n, shard.whole(n))

    found = _merged(docs, short, least)
    known = _known_pairs(found)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, raw in _shards(batches):
            shard = Shard(raw)
            hashes = _hash(shard.texts)
            frequent = np.zeros(len(shard.words) + 2, bool)
            at = shard.suffixes[shard.whole(2)]
            if known is None:
                frequent[at] = True
            else:
                mine = _pair_hashes(hashes[shard.words[at] - 1], hashes[shard.words[at + 1] - 1], lang)
                near = np.searchsorted(known.value, mine)
                frequent[at] = (near < len(known.value)) & (known.value[np.minimum(near, max(0, len(known.value) - 1))] == mine) if len(known.value) else False
            for n in (3, 4):
                ok = shard.whole(n)
                for k in range(n - 1):
                    ok &= frequent[shard.suffixes + k]
                yield from _rows(lang, shard, n, ok)

    return found.unionByName(_merged(docs, long, least))


def _known_pairs(found: DataFrame):
    """A broadcast sorted array of hashes of the pairs, or None if they are too many."""
    pairs = found.where(F.col("phrase").contains(" "))
    if pairs.count() > FILTER_PAIRS:
        return None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column(1).cast(pa.large_string()), " ")
            first, second = (_hash(pc.list_element(split, k)) for k in (0, 1))
            langs = np.array(batch.column(0).to_pylist(), object)
            out = np.zeros(len(batch), _U)
            for lang in set(langs.tolist()):
                own = langs == lang
                out[own] = _pair_hashes(first[own], second[own], lang)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["hashes"])

    held = [r.hashes for r in pairs.select("lang", "phrase").mapInArrow(releasing(hashed), "hashes binary").collect()]
    return found.sparkSession.sparkContext.broadcast(np.sort(np.frombuffer(b"".join(held), _U)))


def _part(phrase: Column, first: Column, n: Column) -> Column:
    """Words first (from 1) to first + n - 1 of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    a, l and r count the phrase and its two parts at the cut of lowest score; phrases that
    mostly occur inside a longer one are dropped.
    """
    counts = materialise(phrase_counts(docs, least, lang_col, text_col).withColumn("words", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))))
    totals = counts.where("words = 0").select("lang", F.col("a").alias("n"))
    candidates = counts.where("words >= 2")
    left = counts.where("words between 1 and 3").select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    right = left.select("lang", F.col("head").alias("tail"), F.col("l").alias("r"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"head": _part(F.col("phrase"), F.lit(1), F.col("k")), "tail": _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k"))})
    score = F.expr("CAST(CAST(2000000 * CAST(a AS decimal(20, 0)) AS decimal(28, 0)) div (CAST(l AS decimal(20, 0)) + r) AS bigint)")
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.expr("filter(flatten(transform(sequence(1, words), i -> transform(sequence(2, words), m -> struct(i AS i, m AS m)))), x -> x.m < words AND x.i + x.m - 1 <= words)")
    inner = candidates.where("words > 2").withColumn("x", F.explode(spans))
    inner = inner.select("lang", _part(F.col("phrase"), F.col("x.i"), F.col("x.m")).alias("phrase"), F.col("a").alias("longer"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = scored.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(longer AS decimal(20, 0)) * 100 < CAST(a AS decimal(20, 0)) * 80")
    rows = stay.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts all phrases of one.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
