import random
import re
from hashlib import sha256

import pytest

from tidemark.llm.queries import op6_substring_dedup
from tidemark.llm.substring_dedup import SuffixAutomaton, covered_words, remove_repeated


def brute(docs, window=20):
    seen, out = {}, []
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    for i in order:
        doc, text = docs[i]
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = bytearray(len(words))
        for p in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[p : p + window]), (doc, p)) != (doc, p):
                gone[p : p + window] = b"\1" * window
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in remove_repeated(df).collect()), key=str)


def test_documents(spark, documents, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = sorted((d, n, gone, sha256(kept).hexdigest()) for d, n, gone, kept in brute(docs))
    assert sorted(tuple(r) for r in op6_substring_dedup(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(make_docs, seed):
    rng = random.Random(seed)
    passages = [[f"{rng.choice('abcd')}{rng.randint(0, 40)}" for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 10) :] if rng.random() < 0.6 else [str(rng.random()) for _ in range(rng.randint(1, 30))]
        docs.append((i * 3 % 61, rng.choice([" ", "\n", "\t "]).join(words)))
    docs += [(100, "tick tock " * 300), (101, "tick tock " * 40), (102, docs[3][1]), (103, docs[3][1])]
    assert got(make_docs(docs)) == brute(docs)


def test_odd_texts(make_docs, odd):
    docs = list(enumerate(odd))
    assert got(make_docs(odd, clash=True)) == brute(docs)


def test_rows_of_the_same_id_keep_each_other(make_docs):
    text = " ".join(map(str, range(30)))
    assert [r[2] for r in got(make_docs([(1, text), (1, text), (2, text)]))] == [0, 0, 30]


def test_rows_without_id_come_last(make_docs):
    text = " ".join(map(str, range(30)))
    assert {r[0]: r[2] for r in got(make_docs([(None, text), (5, text)]))} == {5: 0, None: 30}


def test_empty_table(make_docs):
    assert got(make_docs([])) == []


def test_automaton_matching_statistics():
    rng = random.Random(2)
    for _ in range(100):
        text = [rng.choice("ab") for _ in range(rng.randint(1, 30))]
        probe = [rng.choice("abc") for _ in range(30)]
        automaton = SuffixAutomaton()
        for word in text:
            automaton.extend(word)
        want = {}
        for i in range(2, len(probe)):
            for p in range(len(text) - 2):
                if text[p : p + 3] == probe[i - 2 : i + 1]:
                    want[i] = p + 2
                    break
        assert dict(automaton.stream(probe, 3)) == want


def test_covered_words_need_an_earlier_reference():
    words = b"a b c d e f"
    assert covered_words([(1, 0, words)], [(2, 5, words)], 3) == [(2, 5, 11)]
    assert covered_words([(2, 0, words)], [(1, 5, words)], 3) == []


def test_hot_passage_in_slices(make_docs, monkeypatch):
    """A passage of many documents is dealt over slices of its shard, and shards are many."""
    from tidemark.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(45)]
    docs = []
    for i in range(150):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 50))]
        a = rng.randint(0, 20)
        docs.append((i, " ".join([*own, *passage[a : a + rng.randint(15, 45)], *own[:25]])))
    assert got(make_docs(docs)) == brute(docs)


def test_without_broadcasts(make_docs, documents, monkeypatch):
    from tidemark.llm import _arrow

    monkeypatch.setattr(_arrow, "BROADCAST_ROWS", -1)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(docs)


def test_ids_in_steps_fill_the_shards():
    from tidemark.llm.substring_dedup import _dealt

    for step in (1, 32, 64, 1 << 20):
        assert len({_dealt(i * step, 32) for i in range(64)}) >= 24


def test_rows_without_an_id_are_documents(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(25))
    texts = [(None, f"one {passage}"), (None, f"two {passage} end"), (7, f"{passage} seven"), (None, "alone " * 3)]
    found = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in remove_repeated(make_docs(texts)).collect())
    assert found == [(False, 26, 0), (True, 3, 0), (True, 26, 25), (True, 27, 25)]
