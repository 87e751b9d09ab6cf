"""Language identification by interpolated Kneser-Ney character models.

One character model per language, trained here on a bounded sample of labelled
documents and stored as sorted hash arrays: for each order, the sorted hashes of
n-grams with their log-probabilities, and the sorted hashes of contexts with their
back-off weights.  Up to ``TOGETHER`` languages share an array, with a column each,
so one search serves them all; arrays grow in proportion to the languages.  Hashes
are polynomials over a random weight for each letter, so the alphabet has no bound.
A text gets the language of lowest length-normalised cross-entropy.  Rejection is
calibrated on a part of the sample: a text is rejected if its cross-entropy,
standardised for its length, lies well over the largest of its language there, and
is also nearer to what texts of other languages have under the same model.

Defined results: a null text or one without any letter is ``und`` with score 0 and
is rejected; rows with null ids or labels are never learned from, rows that repeat id
and text are learned from once; of a long labelled text a slice is learned from; without any labelled row every text is ``und``; columns
beyond those named are ignored by the prediction; repeated rows are predicted each for
itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import bounded_batches, broadcast_if_small, column, releasing
from ._words import mix64

UNDETERMINED = "und"
ORDER = 5
#: The bound of the training sample: so many documents a language and in all, and so many characters of each (a slice of a
#: longer one): the driver fits the models, and rows alone wouldn't bound what it holds, nor the models that are broadcast.
SAMPLE_DOCS, SAMPLE_ROWS = 400, 16_000
SAMPLE_CHARS = 4_000
#: Languages that share their arrays.
TOGETHER = 8
#: Symbols scored at once, and characters of texts turned into symbols at once (a longer text is taken alone).
SLICE, BLOCK = 1 << 18, 1 << 20
#: How far over the calibration part's largest standardised cross-entropy a text may lie.
REJECT_MARGIN = 1.25
#: Calibration texts below which no text with a letter is rejected.
LEAST_CALIBRATION = 20

_U = np.uint64
#: Base of the hashes of n-grams, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = _U(pow(_BASE, -1, 1 << 64))
#: The weight of letters not seen in training; non-letters and what comes before a text have weight 0.
_UNSEEN = mix64(np.array([1 << 32], _U))[0]


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Symbols:
    """The symbols of some texts, one after another; runs of non-letters are one 0."""

    weight: np.ndarray  # uint64
    position: np.ndarray  # within its text
    first: np.ndarray  # of each text, and the end

    def hashes(self, start: int, stop: int, order: int) -> list[np.ndarray]:
        """For each order the hashes of the n-grams that end at symbols start..stop; before a text's start all is 0."""
        out, power = [self.weight[start:stop]], 1
        with np.errstate(over="ignore"):
            for back in range(1, order):
                power = power * _BASE % (1 << 64)
                before = np.zeros(stop - start, _U)
                lo = max(start - back, 0)
                before[lo + back - start :] = self.weight[lo : max(lo, stop - back)]
                before[self.position[start:stop] < back] = 0
                out.append(out[-1] + before * _U(power))
        return out


def symbols_of(texts: list[str], table: np.ndarray) -> Symbols:
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=bounds[1:])
    weight = table[points]
    keep = weight > 0
    keep[1:] |= weight[:-1] > 0
    starts = bounds[:-1][bounds[:-1] < len(weight)]
    keep[starts] = weight[starts] > 0
    total = np.zeros(len(weight) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    first = total[bounds]
    weight = weight[keep]
    return Symbols(weight, np.arange(len(weight)) - np.repeat(first[:-1], np.diff(first)), first)


def contexts_of(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hashes of n-grams without their last symbols, given by weight."""
    with np.errstate(over="ignore"):
        return (hashes - last) * _INVERSE


@dataclass
class SortedHashes:
    """Rows of float32 by hash."""

    hashes: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, rows: np.ndarray) -> SortedHashes:
        order = np.argsort(hashes)
        return cls(hashes[order], rows[order].astype(np.float32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, found?) of hashes."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


class Models:
    """Interpolated Kneser-Ney models of a few languages in shared arrays."""

    def __init__(self, texts: list[list[str]], order: int, alphabet: int, table: np.ndarray):
        self.languages, self.alphabet, top = len(texts), alphabet, order
        self.probabilities: list[SortedHashes] = []
        self.backoffs: list[SortedHashes] = []
        #: By order, for each language: n-gram hashes, their last symbols, their hashes without the first symbol, counts.
        counts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(top)]
        for own in texts:
            s = symbols_of(own, table)
            hashes = s.hashes(0, len(s.weight), top)
            at = np.arange(len(s.weight))
            for k in range(top, 0, -1):
                # Below the top continuation counts: distinct symbols before an n-gram.
                found, first, n = np.unique(hashes[k - 1][at], return_index=True, return_counts=True)
                at = at[first]
                counts[k - 1].append((found, s.weight[at], hashes[k - 2][at] if k > 1 else found, n))
        for k, each in enumerate(counts, 1):
            seen, first = np.unique(np.concatenate([c[0] for c in each]), return_index=True)
            own_contexts = contexts_of(seen, np.concatenate([c[1] for c in each])[first])
            contexts, in_context = np.unique(own_contexts, return_inverse=True)
            lower = np.full((len(seen), len(each)), 1.0 / alphabet)
            if k > 1:
                at, _ = self.probabilities[-1].find(np.concatenate([c[2] for c in each])[first])
                lower = np.exp(self.probabilities[-1].rows[at].astype(np.float64))
            p, backoff = np.zeros((len(seen), len(each))), np.ones((len(contexts), len(each)))
            for lang, (codes, _, _, n) in enumerate(each):
                discount = (once := float((n == 1).sum())) / max(1.0, once + 2.0 * float((n == 2).sum()))
                discount = min(max(discount, 0.1), 0.95)
                mine, sums, kinds = np.zeros(len(seen)), np.zeros(len(contexts)), np.zeros(len(contexts))
                mine[np.searchsorted(seen, codes)] = n
                np.add.at(sums, in_context, mine)
                np.add.at(kinds, in_context, mine > 0)
                backoff[:, lang] = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
                p[:, lang] = np.maximum(mine - discount, 0) / np.maximum(sums, 1)[in_context] + backoff[in_context, lang] * lower[:, lang]
            self.probabilities.append(SortedHashes.of(seen, np.log(p)))
            self.backoffs.append(SortedHashes.of(contexts, np.log(backoff)))

    def log_probability(self, hashes: list[np.ndarray], k: int, at: np.ndarray | None = None) -> np.ndarray:
        """A row for each k-gram: its log-probability in each language."""
        chosen = hashes[k - 1] if at is None else hashes[k - 1][at]
        place, found = self.probabilities[k - 1].find(chosen)
        rows = self.probabilities[k - 1].rows
        out = rows[place] if len(rows) else np.zeros((len(chosen), self.languages), np.float32)
        missing = np.flatnonzero(~found)
        if len(missing):
            rest = missing if at is None else at[missing]
            lower = np.full((len(rest), self.languages), -np.log(self.alphabet), np.float32) if k == 1 else self.log_probability(hashes, k - 1, rest)
            there, known = self.backoffs[k - 1].find(contexts_of(hashes[k - 1][rest], hashes[0][rest]))
            if len(self.backoffs[k - 1].rows):
                lower = lower + np.where(known[:, None], self.backoffs[k - 1].rows[there], 0)
            out[missing] = lower
        return out


class KneserNey:
    """Character models of several languages."""

    def __init__(self, languages: list[str], texts: list[list[str]], order: int = ORDER):
        self.languages, self.order = languages, order
        self.letters = "".join(sorted({c for own in texts for t in own for c in t.lower() if c.isalpha()}))
        self.alphabet = len(self.letters) + 2
        table = self.table()
        self.models = [Models(texts[i : i + TOGETHER], order, self.alphabet, table) for i in range(0, len(texts), TOGETHER)]
        self.spread, self.scale, self.limit = [(0.0, 1.0, 1.0)] * len(languages), 8.0, float("inf")
        self.halfway = [float("inf")] * len(languages)

    def table(self) -> np.ndarray:
        """The weight of each code point."""
        out = np.where(_letters(), _UNSEEN, _U(0))
        points = np.array([ord(c) for c in self.letters], np.int64)
        out[points] = mix64(points.astype(_U) + _U(1))
        return out

    def log_probability(self, hashes: list[np.ndarray]) -> np.ndarray:
        """A row for each symbol: its log-probability in each language after the symbols before it."""
        return np.concatenate([m.log_probability(hashes, self.order) for m in self.models], axis=1)

    def cross_entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, a row of cross-entropies by language) of each text; 0 symbols if it has no letter."""
        s = symbols_of(texts, table)
        total = np.zeros((len(texts), len(self.languages)))
        for start in range(0, len(s.weight), SLICE):
            stop = min(start + SLICE, len(s.weight))
            logs = self.log_probability(s.hashes(start, stop, self.order))
            lo, hi = np.searchsorted(s.first, start, "right") - 1, np.searchsorted(s.first, stop, "left")
            edges = np.clip(s.first[lo:hi], start, stop) - start
            own = np.flatnonzero(np.diff(np.append(edges, stop - start)) > 0)
            total[lo + own] += np.add.reduceat(logs, edges[own], axis=0, dtype=np.float64)
        n = np.diff(s.first)
        lettered = np.zeros(len(s.weight) + 1, np.int64)
        np.cumsum(s.weight > 0, out=lettered[1:])
        n = np.where(np.diff(lettered[s.first]) > 0, n, 0)
        return n, -total / np.maximum(n, 1)[:, None]

    def calibrate(self, texts: list[list[str]]) -> None:
        """Set the spread of each language's cross-entropies, the score's scale and the limit of rejection."""
        table, found, standard = self.table(), [], []
        for lang, own in enumerate(texts):
            n, entropy = self.cross_entropies(own, table) if own else (np.zeros(0), np.zeros((0, len(self.languages))))
            n, entropy = n[n > 0], entropy[n > 0]
            if len(n):
                mean = float(np.average(entropy[:, lang], weights=n))
                each = float(np.mean((entropy[:, lang] - mean) ** 2 * n)) ** 0.5 + 1e-6
                between = float(np.std(entropy[n >= np.median(n), lang])) + 1e-3
                self.spread[lang] = (mean, each, between)
                self.halfway[lang] = (mean + float(np.log(self.alphabet))) / 2
                found.append((lang, entropy))
                standard.append(self._standard(n, entropy[:, lang], np.full(len(n), lang)))
        for lang, _ in found:
            if other := [e[:, lang] for k, e in found if k != lang]:
                self.halfway[lang] = (self.spread[lang][0] + float(np.mean(np.concatenate(other)))) / 2
        if found:
            def loss(scale: float) -> float:
                return -sum(float(np.log(self._posterior(e, scale)[:, lang] + 1e-12).sum()) for lang, e in found)

            self.scale = min((2.0**i for i in range(8)), key=loss)
            standard = np.concatenate(standard)
            self.limit = REJECT_MARGIN * max(4.0, float(standard.max())) if len(standard) >= LEAST_CALIBRATION else float("inf")

    def _standard(self, n: np.ndarray, entropy: np.ndarray, lang: np.ndarray) -> np.ndarray:
        mean, each, between = np.array(self.spread)[lang].T
        return (entropy - mean) / np.sqrt(each**2 / np.maximum(n, 1) + between**2)

    @staticmethod
    def _posterior(entropy: np.ndarray, scale: float) -> np.ndarray:
        p = np.exp(-scale * (entropy - entropy.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected?) of each text."""
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        cuts, size = [0], 0
        for i, text in enumerate(texts):
            if size and size + len(text) > BLOCK:
                cuts.append(i)
                size = 0
            size += len(text)
        found = [self.cross_entropies(texts[a:b], table) for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True)]
        n, entropy = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        best = entropy.argmin(axis=1)
        least, score = entropy[np.arange(len(n)), best], self._posterior(entropy, self.scale).max(axis=1)
        rejected = (n == 0) | (self._standard(n, least, best) > self.limit) & (least > np.array(self.halfway)[best])
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
        return names, np.round(np.where(n > 0, score, 0), 6), np.round(np.where(n > 0, least, 0), 6), rejected


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is never learned from; so are those without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int) -> DataFrame:
    """Rows (lang, at, text): at most ``sample_docs`` different labelled texts a language, by the least hash of id and text.

    Rows that repeat id and text are one.  Hashes alone are drawn, counted and ranked; texts are read for those chosen.
    """
    text, id_ = column(text_col).cast("string"), column(id_col).cast("string")
    rows = labelled.where(column(lang_col).isNotNull() & text.isNotNull() & id_.isNotNull())
    rows = rows.select(column(lang_col).cast("string").alias("lang"), text.alias("text"), F.abs(F.xxhash64(F.lit("sample"), id_, text)).alias("at"))
    drawn = rows.select("lang", "at").distinct()
    there = drawn.groupBy("lang").count()
    each = min(sample_docs, max(1, SAMPLE_ROWS // max(1, there.count())))
    # A share by language that keeps a fifth more than asked for, so that a hot language isn't sorted whole.
    share = there.select("lang", (F.lit(float(1 << 63)) * F.least(F.lit(1.0), (1.2 * each + 40) / F.col("count"))).alias("below"))
    drawn = drawn.join(broadcast_if_small(share), "lang").where(F.col("at") <= F.col("below"))
    chosen = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("n") <= each).select("lang", "at")
    begin = F.pmod("at", F.greatest(F.lit(1), F.length("text") - sample_chars + 1)) + 1
    slices = rows.join(broadcast_if_small(chosen), ["lang", "at"]).select("lang", "at", F.substring(F.col("text"), begin.cast("int"), F.lit(sample_chars)).alias("text"))
    return slices.groupBy("lang", "at").agg(F.min("text").alias("text"))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> KneserNey:
    """Fit and calibrate on a sample of at most ``sample_docs`` rows a language, ``SAMPLE_ROWS`` in all, and ``sample_chars`` neighbouring characters of each.

    Rows are taken by the least hash of their ids and texts; three in four fit the models, the rest calibrates.
    """
    by: dict[str, list] = {}
    for row in sorted(_sample(labelled, id_col, text_col, lang_col, sample_docs, sample_chars).collect(), key=lambda r: (r["lang"], r["at"], r["text"])):
        by.setdefault(row["lang"], []).append(row["text"])
    by = {k: v for k, v in by.items() if any(c.isalpha() for t in v for c in t)}
    languages = sorted(by)
    fit = [[t for i, t in enumerate(by[k]) if i % 4 or len(by[k]) < 8] for k in languages]
    model = KneserNey(languages, fit, order)
    model.calibrate([[t for i, t in enumerate(by[k]) if i % 4 == 0] for k in languages])
    return model


PREDICTIONS = ("lang_pred", "score", "cross_entropy", "rejected")


def identify(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score (0 to 1), cross_entropy (nats a symbol) and rejected to rows, in place of columns so named; only the text decides."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [c for c in docs.columns if c.lower() not in PREDICTIONS]
    place = kept.index(text_col)
    docs = docs.select(*map(column, kept))
    shared = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            names, score, entropy, rejected = model.predict(batch.column(place).fill_null("").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], names=[*kept, *PREDICTIONS])

    predictions = T.StructType().add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return docs.mapInArrow(releasing(predicted), T.StructType([*docs.schema, *predictions]))
