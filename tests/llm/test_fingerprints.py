import hashlib
import statistics

from pyspark.sql import functions as F

from tidemark.llm import fingerprints
from tidemark.llm.fingerprints import SEEDS, BITS, fingerprint, lexicon, likeness, with_next
from tidemark.llm.queries import op4_fingerprints


def test_query(spark, documents, sf_dir):
    rows = {r.doc_id: r for r in op4_fingerprints(spark, sf_dir).collect()}
    docs = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    by_text: dict[str, set] = {}
    for i, (doc, text) in enumerate(docs):
        following, half, row = docs[(i + 1) % len(docs)][1], len(text) // 2, rows[doc]
        edited = text[: len(text) - half] + following[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        by_text.setdefault(text, set()).add(row.fingerprint)
    assert all(len(own) == 1 for own in by_text.values())
    assert statistics.mean(r.near_edited for r in rows.values()) > 5 * statistics.mean(r.near_next for r in rows.values())


def plain(docs, kept):
    """I-Match by dictionaries: {doc: (fingerprint, terms in the lexicon)}; terms that the filter lets in by chance count as it says."""
    import re
    import struct
    from collections import Counter

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hash_of = lambda data, seed=42: signed(xxhash.xxh64_intdigest(data, seed % (1 << 64)))
    of_longs = lambda values: __import__("functools").reduce(lambda seed, v: hash_of(struct.pack("<q", v), seed), values, 42)
    words = {d: {hash_of(w.encode()) for w in re.split(r"[^\w]|_", (t or "").lower()) if w} for d, t in docs}
    counts = Counter(w for own in words.values() for w in own)
    band = {w for w, n in counts.items() if 2 <= n <= max(2, int(0.2 * len(docs)))}
    bits = 7 * len(kept)
    inside = lambda t: all(kept[p // 7] >> p % 7 & 1 for p in (t % bits, hash_of(struct.pack("<q", t)) % bits))
    assert all(map(inside, band))
    out = {}
    for d, text in docs:
        own = sorted(w for w in words[d] if w in band or inside(w))
        marks = [of_longs(own) if own else hash_of((text or "").encode())]
        for seed in range(SEEDS):
            for b in BITS:
                chosen = [t for t in own if (t % (1 << 64)) >> (10 * seed) & ((1 << b) - 1) == 0]
                marks.append(of_longs(chosen) if chosen else None)
        out[d] = marks
    return out


def test_against_plain_i_match(spark, documents, sf_dir):
    kept = lexicon(documents)
    docs = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    edited = {}
    for i, (doc, text) in enumerate(docs):
        half = len(text) // 2
        edited[doc] = text[: len(text) - half] + docs[(i + 1) % len(docs)][1][:half]
    own = plain(docs, kept)
    show = lambda marks: ".".join("-" if m is None else f"{m % (1 << 64):016x}" for m in marks)

    def alike(x, y):
        used = [(a, b) for a, b in zip(x, y, strict=True) if a is not None or b is not None]
        return sum(a == b for a, b in used) / len(used)

    got = {r.doc_id: r for r in op4_fingerprints(spark, sf_dir).collect()}
    assert {d: r.fingerprint for d, r in got.items()} == {d: show(m) for d, m in own.items()}
    for i, (doc, _) in enumerate(docs[:60]):
        changed = got[doc].edited_fingerprint.split(".")
        assert got[doc].near_next == alike(own[doc], own[docs[(i + 1) % len(docs)][0]])
        marks = [None if m == "-" else m for m in changed]
        assert got[doc].near_edited == alike([None if m == "-" else m for m in show(own[doc]).split(".")], marks)


def test_neighbours_across_cells(make_docs, monkeypatch):
    """Far-off ids, ids without an order of magnitude in common, and more heads than one cell holds."""
    for cell, ids in ((4, [i * i for i in range(60)]), (8, [*range(400), 2**62, -(2**63), 2**63 - 1]), (8, [2**i for i in range(62)] + [-(2**i) for i in range(62)])):
        monkeypatch.setattr(fingerprints, "CELL", cell)
        docs = make_docs([(i, f"t{i}") for i in ids] + [(None, "tNone60"), (None, "tNone61")], clash=True)
        rows = with_next(docs, lambda text: text).collect()
        after = {r.value: r.next_value for r in rows}
        texts = [f"t{i}" for i in sorted(ids, reverse=True)]
        assert [after[t] for t in texts[:-1]] == texts[1:]
        unnamed = {"tNone60", "tNone61"}
        assert after[texts[-1]] in unnamed, "null ids come last"
        last = (unnamed - {after[texts[-1]]}).pop()
        assert after[after[texts[-1]]] == last and after[last] == texts[0]


def test_odd_texts(make_docs, odd):
    docs = make_docs(odd, clash=True)
    kept = lexicon(docs)
    rows = docs.select("doc_id", fingerprint(F.col("text"), kept).alias("h")).withColumn("self", likeness(F.col("h"), F.col("h"))).collect()
    marks = {r.doc_id: tuple(r.h) for r in rows}
    assert all(len(h) == 1 + SEEDS * len(BITS) and h[0] is not None for h in marks.values())
    assert all(r.self == 1 for r in rows)
    assert marks[0] == marks[1] and marks[5] == marks[6]
    assert marks[3] != marks[4]


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    assert not any(lexicon(docs))
    assert with_next(docs, lambda text: text).collect() == []


def test_band(make_docs):
    """A term of one document and a term of all documents stay out of the lexicon."""
    docs = make_docs([f"common pair{i // 2} single{i}" for i in range(40)])
    kept = lexicon(docs, most_share=0.2)
    mark = lambda text: docs.limit(1).select(fingerprint(F.lit(text), kept).alias("h")).head().h[0]
    assert mark("common pair3 single6") == mark("pair3 single7")
    assert mark("pair3") != mark("pair4")


def test_band_of_many_terms(make_docs, spark):
    """However many terms: none of the band is lost, and hardly any of one document or of most documents comes in."""
    docs = make_docs([" ".join(f"single{i}x{k} pair{i // 2}x{k}" for k in range(400)) + " common" for i in range(600)])
    kept = lexicon(docs)

    def share(*words):
        texts = spark.createDataFrame([(w,) for w in words], "t string")
        # A text without lexicon terms has its own hash in the first place.
        return texts.select((fingerprint(F.col("t"), kept)[0] != F.xxhash64("t")).alias("inside")).where("inside").count() / len(words)

    assert share(*[f"pair{i}x{k}" for i in range(300) for k in range(0, 400, 20)]) == 1
    assert share(*[f"single{i}x{k}" for i in range(600) for k in range(0, 400, 20)]) < 0.01
    assert share("common") == 0
