import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.suffix_dedup import initial_buckets, least_grams, merged, refine, remove_repeated_bytes, same_strings


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text, string by string."""
    raws = [(t or "").encode() for t in texts]
    held = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if held[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone[:-1] & ~np.append(False, gone[:-2]))) if r else 0
        out.append((len(r), int(gone.sum()), spans, bytes(b for b, g in zip(r, gone, strict=False) if not g)))
    return out


def run(docs, **options):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(docs, **options).collect())


def expected(texts, length):
    return Counter((i, *row) for i, row in enumerate(plain(texts, length)))


def corpus(seed, n=60, alphabet="abcdefghij é"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(20, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.4 else word(rng.randint(1, 60)) for _ in range(rng.randint(0, 6)))
        texts.append(text)
    return texts + [texts[3], texts[3], texts[5] + "x", "ab" * 200, "a" * 300, None, "", "z" * 23]


def test_pointers_of_two_bytes_and_three_passes():
    rng = np.random.default_rng(1)
    for letters in (2, 5):
        raw = np.frombuffer(bytes(rng.integers(97, 97 + letters, 3000).tolist()), np.uint8)
        text, n = raw.tobytes(), len(raw)
        begun = initial_buckets(raw)
        finer = refine(begun, np.arange(n), 8, 16)
        for pointers, depth in ((begun, 8), (finer, 24)):
            seen = defaultdict(set)
            for i in range(n - depth + 1):
                seen[text[i : i + depth]].add(int(pointers[i]))
            assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(seen)
        ordered = sorted(range(n - 24 + 1), key=lambda i: text[i : i + 24])
        assert [int(finer[i]) for i in ordered] == sorted(int(finer[i]) for i in ordered)


@pytest.mark.parametrize("length", [9, 24, 40, 200])
def test_same_strings(length):
    rng = np.random.default_rng(length)
    part = bytes(rng.integers(97, 99, 400).tolist())
    text = part + bytes(rng.integers(97, 99, 300).tolist()) + part[50:350] + b"c" * 300
    at = np.arange(len(text) - length + 1)
    found, plainly = defaultdict(set), defaultdict(set)
    for i, p in zip(at.tolist(), same_strings(np.frombuffer(text, np.uint8), at, length).tolist(), strict=True):
        found[p].add(i)
        plainly[text[i : i + length]].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plainly.values()))


def test_anchors_cover_every_start_once_and_agree():
    texts = [t for t in corpus(4) if t]
    raws = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    hashes, text, starts, owns = least_grams(np.frombuffer(b"".join(raws), np.uint8), offsets, 24, 8)
    anchor_of = {}
    covered = Counter()
    for h, t, s, own in zip(hashes.tolist(), text.tolist(), starts.tolist(), owns.tolist(), strict=True):
        for i in range(s, s + own):
            covered[t, i] += 1
            assert anchor_of.setdefault(raws[t][i : i + 24], h) == h
    assert covered == Counter((t, i) for t, r in enumerate(raws) for i in range(len(r) - 23))


@pytest.mark.parametrize("hot", [4096, 3])
def test_as_string_by_string(spark, make_docs, hot):
    texts = corpus(hot)
    assert run(make_docs(texts).repartition(5), length=24, gram=8, hot=hot) == expected(texts, 24)


def test_production_length(spark, make_docs):
    rng = random.Random(7)
    line = lambda k: "".join(rng.choice("abcde ") for _ in range(k))
    passage = line(260)
    texts = [line(rng.randint(0, 300)) + passage[: rng.randint(190, 260)] + line(40) for _ in range(30)] + [line(5000), passage * 3]
    assert run(make_docs(texts)) == expected(texts, 200)


def test_odd_rows(spark, make_docs, odd):
    found = {k: n for k, n in run(make_docs(odd, clash=True)).items()}
    want = Counter()
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        again = i in (7, 8)  # one repeated byte or letter: every string starts again
        want[i, len(raw), len(raw) if again else 0, int(again), b"" if again else raw] += 1
    assert found == want
    assert remove_repeated_bytes(make_docs([])).collect() == []


def test_rows_without_an_id_or_that_repeat_it(spark, make_docs):
    rng = random.Random(3)
    line = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    a, b, c = line(300), line(300), line(220)
    rows = [(None, a), (None, a), (5, b), (5, b + "!"), (6, c), (None, line(210)), (None, "x" + c)]
    found = run(make_docs(rows))
    assert found[None, 300, 300, 1, b""] == 2
    assert found[5, 300, 300, 1, b""] == 1 and found[5, 301, 300, 1, b"!"] == 1
    assert found[6, 220, 220, 1, b""] == 1 and found[None, 221, 220, 1, b"x"] == 1
    assert sum(n for (_, _, gone, *_), n in found.items() if not gone) == 1


def test_one_passage_of_all_documents_is_split(spark, make_docs):
    rng = random.Random(9)
    line = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = line(230)
    texts = [line(50) + passage + line(50) for _ in range(200)]
    for hot in (20, 4096):
        found = run(make_docs(texts).repartition(8), hot=hot)
        assert found == expected(texts, 200)


def test_merged():
    rows = np.array([(5, 9), (0, 3), (3, 4), (6, 7)], np.int64)
    assert merged(rows[:, 0], rows[:, 1]).tolist() == [[0, 4], [5, 9]]
