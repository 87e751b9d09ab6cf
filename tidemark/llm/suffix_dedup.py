"""Substring deduplication over bytes, by suffix arrays with bucket-pointer refinement.

Every byte goes that is covered by a string of ``LENGTH`` bytes that starts at another
place, too, be it in the same text or in another; no occurrence is spared.

A suffix array of a corpus has to be cut into pieces that fit a task, without losing a
match.  So the strings of ``LENGTH`` bytes are dealt out by their anchors, and suffixes
are sorted where strings can be equal:

1. Texts that occur more than once go as a whole; one of each stands for all below.
2. The anchor of a string is its least ``GRAM``-byte gram, the first one on ties.  Equal
   strings have equal anchors.  Neighbouring strings share theirs, so a text has few.
   An anchor that occurs at one place only has no string that occurs again.
3. What is around a repeated anchor (all strings that it is the anchor of) is a context.
   Contexts of an anchor meet in one block, and a block's suffixes are sorted: suffixes
   are put into buckets by their first eight bytes, and all buckets that more than one
   suffix shares are refined by sorting on the bucket pointers of two later offsets.
   Each pass writes the pointers back and the next one reads them, so buckets go
   from 8 bytes to 24, 72 and 200.  Starts of strings that share a bucket then are
   places of one string.

An anchor of a third of all documents would be a large task.  A batch sends equal
contexts once, and what it can settle it settles.  Anchors that still have more than
``HOT`` contexts get initial buckets as long as the strings, which need no refinement:
their strings are numbered by 128 bits of hashes and counted, dealt out by those.

Defined results: a null text is an empty one; texts under ``LENGTH`` bytes lose nothing;
rows without an id, rows that repeat an id and rows that repeat both id and text are
texts for themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, broadcast_if_small, column, materialise, releasing, written
from ._words import mix64, run_hashes, text_buffer

LENGTH, GRAM = 200, 48
#: Bytes of text for each bucket of anchors, and of contexts for each group of blocks, about.
BUCKET_BYTES, GROUP_BYTES = 16 << 20, 3 << 20
LEAST_BUCKETS = 32
#: Bytes of a block at most: three bucket pointers fit one 64-bit key.
BLOCK_BYTES = 1 << 21
#: Contexts of one anchor beyond which its strings are counted one by one.
HOT = 4096

_U = np.uint64
_FOUND, _SENT = 0, 1


def refine(pointers: np.ndarray, at: np.ndarray, first: int, second: int) -> np.ndarray:
    """Bucket pointers of the suffixes ``at``, refined by those at two later offsets.

    A pointer is the place where its bucket begins in the order of all suffixes.  Only
    suffixes of shared buckets are sorted; the others keep their place.  All reads see
    the pointers as they were, so a bucket's depth grows by exactly the offsets.
    """
    n = len(pointers)
    own = pointers[at]
    held = np.bincount(own, minlength=n)
    shared = at[held[own] > 1]
    out = pointers.copy()
    if not len(shared):
        return out
    later = [pointers[np.minimum(shared + k, n - 1)].astype(_U) for k in (first, second)]
    keys = (pointers[shared].astype(_U) << _U(42)) | (later[0] << _U(21)) | later[1]
    order = np.argsort(keys)
    keys, shared = keys[order], shared[order]
    place = np.arange(len(keys))
    new = np.append(True, keys[1:] != keys[:-1])
    bucket = keys >> _U(42)
    begins = np.append(True, bucket[1:] != bucket[:-1])
    out[shared] = bucket.astype(np.int64) + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(begins, place, 0))
    return out


def initial_buckets(raw: np.ndarray) -> np.ndarray:
    """Bucket pointers of all suffixes by their first eight bytes."""
    n = len(raw)
    padded = np.append(raw, np.zeros(16, np.uint8))
    grams = np.empty(n + 8, _U)
    for k in range(8):
        part = np.frombuffer(padded.tobytes()[k : k + (n - k + 7) // 8 * 8 + 8], ">u8")
        grams[k::8] = part[: len(grams[k::8])]
    grams = grams[:n]
    order = np.argsort(grams)
    ordered = grams[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    pointers = np.empty(n, np.int64)
    pointers[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return pointers


def same_strings(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start in ``at`` the pointer of its bucket: equal if and only if the next ``length`` bytes are."""
    pointers, depth, every = initial_buckets(raw), 8, np.arange(len(raw))
    while 3 * depth < length:
        pointers, depth = refine(pointers, every, depth, 2 * depth), 3 * depth
    # Buckets of this depth overlap so that the last pass ends at the length.
    last = length - depth
    return refine(pointers, at, min(depth, last), last)[at]


def least_grams(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of a batch of texts: (gram's hash, text, first start that has it, number of such starts)."""
    n, width = len(raw), length - gram + 1
    starts = n - length + 1
    if starts <= 0:
        return np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3))
    hashes = run_hashes(raw, gram)
    at = np.arange(len(hashes))
    # A gram's order is the upper bits of its hash, then its place: the least of a window is its first least gram.
    bits = _U(int(n).bit_length())
    least, have = (hashes >> bits << bits) | at.astype(_U), 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    anchor = (least[:starts] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    whole = np.ones(starts, bool)
    for stop in offsets[1:-1].tolist():
        whole[max(0, stop - length + 1) : stop] = False
    new = np.append(True, anchor[1:] != anchor[:-1]) & whole
    new[1:] |= whole[1:] & ~whole[:-1]
    begins = np.flatnonzero(new)
    ends = np.minimum.reduceat(np.where(whole, n, np.arange(starts)), begins) if len(begins) else begins
    stop = np.minimum(np.append(begins[1:], starts), ends)
    text = np.searchsorted(offsets, begins, side="right") - 1
    return hashes[anchor[begins]], text, begins - offsets[text], stop - begins


PLACES = "bucket int, kind int, key long, hashes binary, keys binary, starts binary, owns binary"
_PLACE_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in names.split(", ")])


def _cuts(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        at = np.append(np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])), len(sorted_values)).tolist()
        yield from zip(at[:-1], at[1:], strict=True)


def _settled(columns: tuple[np.ndarray, ...], buckets: int) -> tuple[list[tuple], np.ndarray]:
    """Rows by text of the anchors that are at two places or more, and which entry comes first of each anchor.

    columns: hashes, keys, starts, owns.  An entry that is there twice is one place.
    """
    order = np.lexsort((columns[2], columns[1], columns[0]))
    hashes, keys, starts, owns = (c[order] for c in columns)
    new = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
    other = new | np.append(True, (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])) if len(hashes) else new
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group, weights=other, minlength=1) > 1)[group] & other if len(hashes) else other
    rows, by = [], np.flatnonzero(repeated)
    by = by[np.argsort(keys[by], kind="stable")]
    bucket = (mix64(keys[by].astype(_U)) % _U(buckets)).astype(np.int64)
    for a, b in _cuts(keys[by]):
        o = by[a:b]
        rows.append((int(bucket[a]), _FOUND, int(keys[o[0]]), hashes[o].tobytes(), b"", starts[o].astype(np.uint32).tobytes(), owns[o].astype(np.uint16).tobytes()))
    return rows, order[new]


def _sent(columns: tuple[np.ndarray, ...], buckets: int) -> list[tuple]:
    bucket = (columns[0] % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return [
        (int(bucket[o[0]]), _SENT, None, columns[0][o].tobytes(), columns[1][o].tobytes(), columns[2][o].astype(np.uint32).tobytes(), columns[3][o].astype(np.uint16).tobytes())
        for a, b in _cuts(bucket[order])
        for o in (order[a:b],)
    ]


def _repeated_anchors(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """By text: hashes of its repeated anchors, first starts that have them, and how many starts have."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, text, starts, owns = least_grams(*text_buffer(batch.column(1)), length, gram)
            columns = hashes, batch.column(0).to_numpy()[text], starts, owns
            rows, first = _settled(columns, buckets)
            yield _batch(rows + _sent(tuple(c[first] for c in columns), buckets), PLACES, _PLACE_TYPES)

    def met(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        sent = table.filter(pa.array(kinds == _SENT))
        load = lambda name, of: np.frombuffer(b"".join(sent[name].to_pylist()), of)
        rows, _ = _settled((load("hashes", _U), load("keys", np.int64), load("starts", np.uint32).astype(np.int64), load("owns", np.uint16).astype(np.int64)), buckets)
        return pa.concat_tables([table.filter(pa.array(kinds == _FOUND)), pa.Table.from_batches([_batch(rows, PLACES, _PLACE_TYPES)])])

    found = texts.mapInArrow(releasing(anchors), PLACES).groupBy("bucket").applyInArrow(met, PLACES)
    return found.groupBy("key").agg(F.collect_list(F.struct("hashes", "starts", "owns")).alias("found"))


#: kind 0: a span (key, start, stop) to remove; 1: a context of an anchor at start, with as many starts of strings as ``stop`` says.
CONTEXTS = "kind int, key long, start long, stop long, anchor long, often boolean, part binary"
_CONTEXT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _contexts(texts: DataFrame, anchors: DataFrame, length: int) -> DataFrame:
    """Contexts of repeated anchors, each once a batch; those that a batch holds twice are spans, too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                hashes, starts, owns = (np.frombuffer(b"".join(x[name] for x in found), of).astype(np.int64) for name, of in (("hashes", np.int64), ("starts", np.uint32), ("owns", np.uint16)))
                # An anchor may come from its batch and from its bucket: it is one place.
                starts, once = np.unique(starts, return_index=True)
                for anchor, a, own in zip(hashes[once].tolist(), starts.tolist(), owns[once].tolist(), strict=True):
                    seen.setdefault((anchor, raw[a : a + own + length - 1]), []).append((key, a, own))
            rows = []
            for (anchor, part), places in seen.items():
                often = len(set(places)) > 1
                rows.append((1, *places[0], anchor, often, part))
                if often:
                    rows += [(0, key, a, a + own + length - 1, None, None, None) for key, a, own in places]
            yield _batch(rows, CONTEXTS, _CONTEXT_TYPES)

    return texts.join(anchors, "key").select("key", "text", "found").mapInArrow(releasing(cut), CONTEXTS)


def repeated_starts(parts: list[bytes], often: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For each of some different contexts the starts of strings that another place has, too."""
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes) - sizes
    owns = sizes - length + 1
    of = np.repeat(np.arange(len(parts)), owns)
    within = np.arange(len(of)) - np.repeat(np.cumsum(owns) - owns, owns)
    bucket = same_strings(np.frombuffer(b"".join(parts), np.uint8), begins[of] + within, length)
    places = np.bincount(bucket, weights=1 + np.array(often)[of])
    repeated = places[bucket] > 1
    return np.split(within[repeated], np.searchsorted(of[repeated], np.arange(1, len(parts))))


def _runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from ((int(at[a]), int(at[b - 1])) for a, b in _cuts(at - np.arange(len(at))))


SPANS = "key long, start long, stop long"


def _spans(rows: list[tuple[int, int, int]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "stop"])


def _sorted_spans(contexts: DataFrame, groups: int, length: int) -> DataFrame:
    """Spans that suffix arrays of the anchors' contexts find; an anchor's contexts are in one block."""

    def blocks(table: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        met: dict[int, dict[bytes, dict[tuple[int, int], bool]]] = {}
        for key, start, anchor, often, part in zip(*(table[c].to_pylist() for c in ("key", "start", "anchor", "often", "part")), strict=True):
            met.setdefault(anchor, {}).setdefault(part, {})[key, start] = often
        parts: list[bytes] = []
        places: list[tuple[tuple[int, int], bool]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if parts:
                for ((key, start), often), at in zip(places, repeated_starts(parts, [o for _, o in places], length), strict=True):
                    if not often:
                        rows.extend((key, start + a, start + b + length) for a, b in _runs(at))
                parts.clear()
                places.clear()
                size = 0

        for contexts in met.values():
            one = [(part, *next(iter(at.items())), len(at) > 1) for part, at in contexts.items()]
            # Batches that sent equal contexts settle all of it.  One context alone has nothing to meet: its strings have their anchor at different offsets.
            rows += [(key, start, start + len(part)) for part, at in contexts.items() if len(at) > 1 for key, start in at]
            if len(one) == 1:
                continue
            more = sum(len(part) for part, *_ in one)
            if size + more > BLOCK_BYTES:
                settle()
            for part, place, often, several in one:
                parts.append(part)
                places.append((place, often or several))
            size += more
        settle()
        return _spans(rows)

    dealt = contexts.withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    return dealt.select("group", "key", "start", "anchor", "often", "part").groupBy("group").applyInArrow(blocks, SPANS)


NUMBERED = "bucket int, key long, start long, stop long, strings binary, others binary, keys binary, starts binary, often binary"
_NUMBERED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]


def _counted_spans(contexts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Spans of anchors with very many contexts: each string by itself, numbered by two hashes."""

    def spans_of(columns: tuple[np.ndarray, ...]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        strings, others, keys, starts, often = (c[order] for c in columns)
        new = np.append(True, (strings[1:] != strings[:-1]) | (others[1:] != others[:-1])) if len(order) else np.zeros(0, bool)
        place = new | np.append(True, (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1])) if len(order) else new
        group = np.cumsum(new) - 1
        repeated = (np.bincount(group, weights=place + (often > 0), minlength=1) > 1)[group] if len(order) else new
        rows = []
        keys, starts = keys[repeated], starts[repeated]
        by = np.lexsort((starts, keys))
        for a, b in _cuts(keys[by]):
            rows += [(int(keys[by[a]]), s, e + length) for s, e in _runs(np.sort(starts[by[a:b]]))]
        # The first place of each string stands for all; it is there often if any other is.
        return rows, order[new]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(3).to_pylist()
            raw, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
            owns = np.diff(offsets) - length + 1
            within = np.arange(owns.sum()) - np.repeat(np.cumsum(owns) - owns, owns)
            at = np.repeat(offsets[:-1], owns) + within
            strings, others = (run_hashes(x, length)[at] for x in (raw, raw ^ 0xFF))
            columns = strings, others, np.repeat(batch.column(0).to_numpy(), owns), np.repeat(batch.column(1).to_numpy(), owns) + within, np.repeat(np.asarray(batch.column(2).to_pylist(), np.uint8), owns)
            found, first = spans_of(columns)
            order = np.lexsort((others, strings))
            again = np.zeros(len(at), bool)
            same = (strings[order][1:] == strings[order][:-1]) & (others[order][1:] == others[order][:-1])
            again[order[1:][same]] = again[order[:-1][same]] = True
            bucket = (strings[first] % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = [(None, *span, None, None, None, None, None) for span in found]
            for a, b in _cuts(bucket[order]):
                o = first[order[a:b]]
                rows.append((int(bucket[order[a]]), None, None, None, *(columns[k][o].tobytes() for k in range(4)), (columns[4][o] | again[o]).astype(np.uint8).tobytes()))
            yield _batch(rows, NUMBERED, _NUMBERED_TYPES)

    def met(table: pa.Table) -> pa.Table:
        load = lambda name, of: np.frombuffer(b"".join(table[name].to_pylist()), of)
        return _spans(spans_of(tuple(load(name, of) for name, of in (("strings", _U), ("others", _U), ("keys", np.int64), ("starts", np.int64), ("often", np.uint8))))[0])

    sent = materialise(contexts.select("key", "start", "often", "part").mapInArrow(releasing(numbered), NUMBERED))
    return sent.where("bucket is null").select("key", "start", "stop").unionByName(sent.where("bucket is not null").groupBy("bucket").applyInArrow(met, SPANS))


def merged(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Rows (start, stop) in order, those that overlap or touch as one."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order]) if len(order) else stops
    new = np.append(True, starts[1:] > stops[:-1]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return np.stack([starts[at], stops[np.append(at[1:], len(starts)) - 1]], 1) if len(at) else np.zeros((0, 2), np.int64)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, copied, spans) for each row of docs.

    copied: the text is there more than once; spans: else the byte ranges to remove,
    64-bit integers start, stop, start, ... in order.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has at least 8 bytes and at most the string's length")
    bounded_batches(docs.sparkSession)
    hot = min(hot, BLOCK_BYTES // (2 * length))  # so that an anchor's contexts fit a block
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    named = materialise(docs.where(F.octet_length("text") >= length).select("doc_id", F.md5("text").alias("name")))
    equal = named.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").select("name", "least", F.lit(True).alias("copied"))
    equal = broadcast_if_small(equal)
    known = docs.withColumn("name", F.when(F.octet_length("text") >= length, F.md5("text"))).join(equal, "name", "left").withColumn("key", F.xxhash64("name"))
    # One row of equal texts stands for all; rows that repeat the id, too, give the same places again.
    texts = known.where(F.col("name").isNotNull() & (F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))).select("key", "text")
    # Repeated anchors are many and grow with the texts: both meet by a shuffle, at any size.
    contexts = written(_contexts(texts, _repeated_anchors(texts, length, gram, buckets), length))
    found = contexts.where("kind = 0").select("key", "start", "stop")
    contexts = contexts.where("kind = 1").select("key", "start", "anchor", "often", "part")
    crowded = contexts.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    crowded = broadcast_if_small(crowded)
    total = contexts.agg(F.sum(F.octet_length("part").cast("long"))).head()[0] or 0
    few = contexts.join(crowded, "anchor", "left_anti")
    spans = found.unionByName(_sorted_spans(few, max(LEAST_BUCKETS, -(-total // GROUP_BYTES)), length))
    if not crowded.isEmpty():
        spans = spans.unionByName(_counted_spans(contexts.join(crowded, "anchor", "left_semi"), buckets, length))
    spans = spans.groupBy("key").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    spans = broadcast_if_small(spans.mapInArrow(releasing(_packed), "key long, spans binary"), "octet_length(spans)")
    return known.join(spans, "key", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a text, merged, as 64-bit integers start, stop, start, ..."""
    for batch in batches:
        spans = [merged(np.array(a, np.int64), np.array(b, np.int64)).tobytes() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary())], names=["key", "spans"])


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes that stay."""
    names = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    types = [*[pa.int64()] * 4, pa.binary()]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, copied, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if copied:
                    rows.append((doc, len(raw), len(raw), 1, b""))
                    continue
                gone = np.frombuffer(spans or b"", np.int64)
                at = [0, *gone.tolist(), len(raw)]
                stay = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
                rows.append((doc, len(raw), len(raw) - len(stay), len(gone) // 2, stay))
            yield _batch(rows, names, types)

    return repeated_bytes(docs, length, gram, hot, id_col, text_col).mapInArrow(releasing(kept), names)
