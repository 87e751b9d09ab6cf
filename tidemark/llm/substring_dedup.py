"""Substring deduplication by suffix automata of reference shards.

Of every run of ``WINDOW`` words that the corpus holds more than once only the first
occurrence stays.  References are the regions where repeated windows occur first.
They are dealt into shards of bounded size, each shard becomes a suffix automaton over
words, copied to every task that streams documents through it, and the matching
statistics find the spans: maximal runs of words in matches of ``WINDOW`` words or more
whose first end in the references lies earlier than the place read.

An automaton of a whole corpus fits nowhere, and streaming every document through
every shard would be quadratic.  So hashes prune what can't match, and nothing else:

1. equal texts: all but the one of least id are later occurrences as a whole;
2. anchors (the least 10-word hash of each window) that occur once are dropped;
3. windows of the remaining anchors name the references and the shards that a document
   has to be streamed through;
4. of a document the stretches around such windows are streamed, a window more on
   either side; where spans begin and end only the automaton says.

The stretches of a shard are dealt into slices of bounded size, each a task with the
shard's automaton, so a passage that many documents share is no large task.

A batch of documents sends an anchor or a window once, however often it holds it, and
settles its own repetitions against its own first occurrence; so a passage that a
third of all documents share is a few entries a batch.

Defined results: words are maximal runs of bytes but white space; a null text has no
words; texts of fewer words than a window lose nothing; rows with the same id are
one place, so equal ones don't remove each other; rows without an id come last, in the
order of a hash of their texts, equal ones as one place; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, broadcast_if_small, materialise, releasing
from ._words import Words, mix64, window_hashes, words_of

WINDOW, ANCHOR = 20, 10
#: Bytes of text for each bucket of hashes and each shard, about; the bound of a task's memory.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 32
#: Words of references in a shard, and bytes of stretches in a slice, about.
SHARD_WORDS, SLICE_BYTES = 250_000, 4 << 20

#: Keys of rows without an id begin here.
_NAMELESS = 1 << 62
_U = np.uint64


def _dealt(doc: int, n: int) -> int:
    """One of n numbers for a document, whatever its ids have in common."""
    return int(mix64(np.array([doc], np.int64).astype(_U))[0] % _U(n))


def _least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the position of the first least value among the next ``width``."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at[:n]


class Batch:
    """Words of some documents with the starts of their windows and each window's anchor."""

    def __init__(self, ids: np.ndarray, words: Words, window: int, anchor: int):
        self.ids, self.words, count = ids, words, len(words.hash)
        self.doc_of = np.repeat(np.arange(len(ids)), np.diff(words.first))
        last = count - window + 1
        if last > 0:
            self.starts = np.flatnonzero(self.doc_of[:last] == self.doc_of[window - 1 :])
            self.grams = window_hashes(words.hash, anchor)
            self.anchors = _least_positions(self.grams, window - anchor + 1)[self.starts]
        else:
            self.starts = self.anchors = np.zeros(0, np.int64)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, word positions in their documents) of batch positions."""
        doc = self.doc_of[at]
        return self.ids[doc], at - self.words.first[doc]


def _batch(batch: pa.RecordBatch, window: int, anchor: int) -> Batch:
    return Batch(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), words_of(batch.column(1)), window, anchor)


def _groups(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): order sorts by key, id and place; first[i] is the row of order[i]'s key that comes first."""
    order = np.lexsort((places, ids, keys))
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order, np.repeat(order[starts], np.diff(np.append(starts, len(keys))))


ENTRIES = "bucket int, kind int, doc_id long, keys binary, ids binary, places binary, ref_ids binary, ref_places binary"
_NAMES = ["bucket", "kind", "doc_id", "keys", "ids", "places", "ref_ids", "ref_places"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
#: Kinds of entries: sent to its bucket; settled later windows, and references, of a document; the same as runs.
_SENT, _LATER, _REFERENCE, _LATER_RUNS, _REFERENCE_RUNS = 0, 1, 2, 3, 4


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _sent(keys: np.ndarray, ids: np.ndarray, places: np.ndarray, buckets: int) -> list[tuple]:
    bucket = (keys % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [
        (b, _SENT, None, keys[o].tobytes(), ids[o].tobytes(), places[o].astype(np.uint32).tobytes(), b"", b"")
        for b in np.flatnonzero(np.diff(cuts)).tolist()
        for o in (order[cuts[b] : cuts[b + 1]],)
    ]


def _by_document(kind: int, buckets: int, ids: np.ndarray, places: np.ndarray, ref_ids: np.ndarray | None = None, ref_places: np.ndarray | None = None) -> list[tuple]:
    if not len(ids):
        return []
    order = np.argsort(ids, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(ids[order]) != 0)), len(ids))
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        o, doc = order[a:b], int(ids[order[a]])
        refs = (b"", b"") if ref_ids is None else (ref_ids[o].tobytes(), ref_places[o].astype(np.uint32).tobytes())
        rows.append((_dealt(doc, buckets), kind, doc, b"", b"", places[o].astype(np.uint32).tobytes(), *refs))
    return rows


def _as_runs(rows: list[tuple]) -> list[tuple]:
    """Rows by document with runs in place of windows."""
    out = []
    for bucket, kind, doc, _, _, places, ref_ids, ref_places in rows:
        at = np.frombuffer(places, np.uint32).astype(np.int64)
        if kind == _LATER:
            runs = later_runs(at, np.frombuffer(ref_ids, np.int64), np.frombuffer(ref_places, np.uint32).astype(np.int64))
            out.append((bucket, _LATER_RUNS, doc, b"", b"", runs, b"", b""))
        else:
            out.append((bucket, _REFERENCE_RUNS, doc, b"", b"", reference_runs(at), b"", b""))
    return out


def reference_runs(at: np.ndarray) -> bytes:
    """Pairs (start, stop) of consecutive windows."""
    at = np.unique(at)
    return np.array([(at[a], at[b - 1] + 1) for a, b in _runs(at)], np.int64).tobytes()


def later_runs(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> bytes:
    """Tuples (start, stop, reference, its start) of windows that are consecutive in both places."""
    order = np.lexsort((at, at - ref_at, ref))
    at, ref, ref_at = at[order], ref[order], ref_at[order]
    return np.array([(at[a], at[b - 1] + 1, ref[a], ref_at[a]) for a, b in _runs(at, ref, ref_at)], np.int64).tobytes()


def _settle(keys: np.ndarray, ids: np.ndarray, places: np.ndarray, buckets: int, references: bool) -> tuple[list[tuple], np.ndarray]:
    """Rows by document for keys that occur again, and the rows that come first of their keys.

    A later window refers to the one before it if that is in the same document (a
    repeated line then is one long run), else to the first of all.
    """
    order, first = _groups(keys, ids, places)
    later = (ids[order] != ids[first]) | (places[order] != places[first])
    firsts = np.unique(first)
    if references:
        refer = first.copy()
        before = np.flatnonzero(later[1:] & (ids[order][1:] == ids[order][:-1]) & (places[order][1:] != places[order][:-1])) + 1
        refer[before] = order[before - 1]
        refer = refer[later]
        rows = _by_document(_LATER, buckets, ids[order][later], places[order][later], ids[refer], places[refer])
        met = np.unique(refer)
        return rows + _by_document(_REFERENCE, buckets, ids[met], places[met]), firsts
    repeated = np.zeros(len(keys), bool)
    repeated[first[later]] = True
    repeated[order[later]] = True
    return _by_document(_LATER, buckets, ids[repeated], places[repeated]), firsts


def _resolve(buckets: int, references: bool):
    """Bring together what batches sent to a bucket; what they settled passes through."""

    def resolve(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        sent = table.filter(pa.array(kind == _SENT))
        join = lambda name, of: np.frombuffer(b"".join(sent[name].to_pylist()), of)
        rows, _ = _settle(join("keys", _U), join("ids", np.int64), join("places", np.uint32).astype(np.int64), buckets, references)
        return pa.concat_tables([table.filter(pa.array(kind != _SENT)), pa.Table.from_batches([_table(rows)])])

    return resolve


def _entries(docs: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """Places of repeated anchors, by document."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _batch(batch, window, anchor)
            at = np.unique(b.anchors)
            ids, places = b.places(at)
            keys = b.grams[at] if len(at) else np.zeros(0, _U)
            rows, firsts = _settle(keys, ids, places, buckets, False)
            yield _table(rows + _sent(keys[firsts], ids[firsts], places[firsts], buckets))

    found = docs.mapInArrow(releasing(anchors), ENTRIES).groupBy("bucket").applyInArrow(_resolve(buckets, False), ENTRIES)
    found = found.groupBy("doc_id").agg(F.collect_list("places").alias("found"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.compress(np.diff(np.unique(np.frombuffer(b"".join(x), np.uint32)), prepend=np.uint32(0)).tobytes(), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "found"])

    return found.mapInArrow(releasing(packed), "doc_id long, found binary")


def _occurrences(docs: DataFrame, repeated: DataFrame, window: int, anchor: int, buckets: int) -> DataFrame:
    """By document: runs of windows that are references (start, stop), and of later ones (start, stop, where they are first)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _batch(batch, window, anchor)
            chosen = np.zeros(len(b.words.hash) + 1, bool)
            for doc, found in enumerate(batch.column(2).to_pylist()):
                chosen[b.words.first[doc] + np.cumsum(np.frombuffer(zlib.decompress(found), np.uint32), dtype=np.int64)] = True
            at = b.starts[chosen[b.anchors]]
            ids, places = b.places(at)
            keys = window_hashes(b.words.hash, window)[at] if len(at) else np.zeros(0, _U)
            rows, firsts = _settle(keys, ids, places, buckets, True)
            yield _table(_as_runs(rows) + _sent(keys[firsts], ids[firsts], places[firsts], buckets))

    met = docs.join(repeated, "doc_id").select("doc_id", "text", "found")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, later, words = [], [], []
            for found in batch.column(1).to_pylist():
                load = lambda kind, name, of, found=found: np.frombuffer(b"".join(x[name] for x in found if x["kind"] == kind), of).astype(np.int64)
                own.append(load(_REFERENCE_RUNS, "places", np.int64).tobytes() + reference_runs(load(_REFERENCE, "places", np.uint32)))
                words.append(sum(b + window - 1 - a for a, b in merged(np.frombuffer(own[-1], np.int64).reshape(-1, 2))))
                later.append(load(_LATER_RUNS, "places", np.int64).tobytes() + later_runs(load(_LATER, "places", np.uint32), load(_LATER, "ref_ids", np.int64), load(_LATER, "ref_places", np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), pa.array(later, pa.binary()), pa.array(words, pa.int64())], names=["doc_id", "own", "later", "words"])

    found = met.mapInArrow(releasing(windows), ENTRIES).groupBy("bucket").applyInArrow(_resolve(buckets, True), ENTRIES)
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "places", "ref_ids", "ref_places")).alias("found"))
    return found.mapInArrow(releasing(runs), "doc_id long, own binary, later binary, words long")


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in which the first column and the last go up by one, and those between stay."""
    n = len(columns[0])
    if not n:
        return []
    new = np.diff(columns[0]) != 1
    if len(columns) > 1:
        new |= (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 1)
    cuts = np.concatenate(([0], np.flatnonzero(new) + 1, [n]))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Ranges (start, stop) in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


REGIONS = "shard int, kind int, doc_id long, place long, words binary"


def _regions(docs: DataFrame, occurrences: DataFrame, window: int, shards: int) -> DataFrame:
    """Regions of text for the shards: references, and stretches of documents around windows that a shard's references hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                for a, b in merged(np.frombuffer(own, np.int64).reshape(-1, 2)):
                    rows.append((_dealt(doc, shards), _REFERENCE, doc, a, b" ".join(words[a : b + window - 1])))
                runs = np.frombuffer(later, np.int64).reshape(-1, 4)
                shard = (mix64(runs[:, 2].astype(_U)) % _U(shards)).astype(np.int64)
                for k in np.unique(shard).tolist():
                    near = runs[shard == k, :2] + np.array([-window, 2 * window - 1])
                    for a, b in merged(np.clip(near, 0, len(words))):
                        rows.append((k, _LATER, doc, a, b" ".join(words[a:b])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "kind", "doc_id", "place", "words"])

    return docs.join(occurrences, "doc_id").select("doc_id", "text", "own", "later").mapInArrow(releasing(cut), REGIONS)


class SuffixAutomaton:
    """All runs of words of some references; each state knows where its runs end first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [-1]
        self.last, self.size = 0, 0

    def extend(self, word) -> None:
        nexts, link, length, ends = self.next, self.link, self.length, self.ends
        new, p = len(nexts), self.last
        nexts.append({})
        link.append(0)
        length.append(length[p] + 1)
        ends.append(self.size)
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] != length[p] + 1:
                copy = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        self.last = new
        self.size += 1

    def stream(self, words: list, least: int) -> Iterator[tuple[int, int]]:
        """Matching statistics of at least ``least`` words: (end here, first end in the references)."""
        nexts, link, length, state, matched = self.next, self.link, self.length, 0, 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            if matched >= least:
                at = state
                while length[link[at]] >= least:
                    at = link[at]
                yield i, self.ends[at]


def covered_words(references: list[tuple[int, int, bytes]], later: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """(doc, from, to): words of the stretches in windows that a reference holds earlier.

    Regions are (doc, place of the first word, words joined by a space).
    """
    automaton, starts, where = SuffixAutomaton(), [], []
    for doc, place, text in sorted(references, key=lambda r: r[:2]):
        starts.append(automaton.size)
        where.append((doc, place))
        for word in text.split():
            automaton.extend(word)
        automaton.extend(None)  # no region goes on into the next one
    out = []
    for doc, place, text in later:
        a = b = -1
        for i, end in automaton.stream(text.split(), window):
            region = bisect_right(starts, end) - 1
            if (where[region][0], where[region][1] + end - window + 1 - starts[region]) < (doc, place + i - window + 1):
                if i - window + 1 > b:
                    if b > a:
                        out.append((doc, place + a, place + b))
                    a = i - window + 1
                b = i + 1
        if b > a:
            out.append((doc, place + a, place + b))
    return out


def _spans(regions: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, start, stop): what the automata find in the stretches."""

    def matched(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        rows = list(zip(table["doc_id"].to_pylist(), table["place"].to_pylist(), table["words"].to_pylist(), strict=True))
        found = covered_words([r for r, k in zip(rows, kinds, strict=True) if k == _REFERENCE], [r for r, k in zip(rows, kinds, strict=True) if k == _LATER], window)
        columns = list(zip(*found, strict=True)) if found else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "stop"])

    regions = materialise(regions)
    slices = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("words").cast("long")) / SLICE_BYTES)).cast("int")
    load = broadcast_if_small(regions.where(F.col("kind") == _LATER).groupBy("shard").agg(slices.alias("slices")))
    regions = regions.join(load, "shard")  # a shard without stretches has nothing to find
    stretches = regions.where(F.col("kind") == _LATER).withColumn("slice", F.pmod(F.xxhash64("doc_id", "place"), F.col("slices")).cast("int"))
    references = regions.where(F.col("kind") == _REFERENCE).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return stretches.unionByName(references).groupBy("shard", "slice").applyInArrow(matched, "doc_id long, start long, stop long")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, nameless, copy, spans) for each document; a nameless one, without an id, has a key in its place.

    copy: an equal text has a lesser id, so all its windows are repetitions; spans:
    else the word ranges to remove, pairs (start, stop) of 64-bit integers.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A row without an id comes after those with one, by a hash of its text; so such rows are documents, not one document.
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 2))
    docs = docs.select(key.alias("doc_id"), text.alias("text"), F.col(id_col).isNull().alias("nameless"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    # Copies are found by name and id alone, so texts never meet by a name that many rows share.
    named = materialise(docs.select("doc_id", F.md5("text").alias("name")))
    equal = named.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("name", "least")
    copies = named.join(broadcast_if_small(equal), "name").where("doc_id > least").select("doc_id", "name", F.lit(True).alias("copy")).distinct()
    named = docs.withColumn("name", F.md5("text")).join(broadcast_if_small(copies), ["doc_id", "name"], "left").select("doc_id", "text", "nameless", F.coalesce("copy", F.lit(False)).alias("copy"))
    single = named.where("not copy").select("doc_id", "text")
    repeated = broadcast_if_small(_entries(single, window, anchor, buckets), "octet_length(found)")
    occurrences = broadcast_if_small(_occurrences(single, repeated, window, anchor, buckets), "octet_length(own) + octet_length(later)")
    words = occurrences.agg(F.sum("words")).head()[0] or 0
    shards = max(LEAST_BUCKETS, -(-words // SHARD_WORDS))
    spans = _spans(_regions(single, occurrences, window, shards), window).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(merged(np.array([(x["start"], x["stop"]) for x in spans], np.int64)), np.int64).tobytes() for spans in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "spans"])

    spans = broadcast_if_small(spans.mapInArrow(releasing(packed), "doc_id long, spans binary"), "octet_length(spans)")
    return named.join(spans, "doc_id", "left")


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): kept is the words that stay, joined by one space."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, copy, spans, nameless in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif spans and not copy:
                    stay = np.ones(n, bool)
                    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                        stay[a:b] = False
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                out.append((None if nameless else doc, n, n - len(words), b" ".join(words)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    found = repeated_spans(docs, window, anchor, id_col, text_col).select("doc_id", "text", "copy", "spans", "nameless")
    return found.mapInArrow(releasing(kept), "doc_id long, n_words long, n_removed long, kept binary")
