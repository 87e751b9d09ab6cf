import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.packing import OpenBins, WordIds, best_fit_decreasing, pack_documents
from tidemark.llm.queries import WORD_TOKENIZER, tokenizer_path

PATH = tokenizer_path(WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, docs):
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            yield doc, piece, at, len(part), zlib.crc32(part.tobytes())


def check(rows, docs, library):
    assert sorted(r[:5] for r in rows) == sorted(expected(library, docs))
    places = defaultdict(list)
    for r in rows:
        places[r[5]].append((r[6], r[3]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_documents(spark, documents, library):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = [tuple(r) for r in pack_documents(documents, PATH).collect()]
    total = sum(r[3] for r in rows)
    assert check(rows, docs, library) <= -(-total // 2048) * 1.02 + 1


def test_odd_texts(make_docs, odd, library):
    texts = [*odd, "<|endoftext|>!", "don't. won't, 5, 6; İ! É,"]
    rows = [tuple(r) for r in pack_documents(make_docs(texts, clash=True), PATH).collect()]
    check(rows, list(enumerate(texts)), library)


def test_repeated_rows_and_groups(make_docs, library):
    docs = [(1, "one two three")] * 5 + [(None, "no id")]
    rows = [tuple(r) for r in pack_documents(make_docs(docs), PATH, group_pieces=2).collect()]
    assert len(rows) == 6
    assert sorted(r[3] for r in rows) == [3, 4, 4, 4, 4, 4]


def test_empty_table(make_docs):
    assert pack_documents(make_docs([]), PATH).collect() == []


def test_word_ids_fuzz(library):
    rng, words = random.Random(5), WordIds(PATH)
    letters = [*"abİſÉ×÷'.,!?;:|<>-_1 2́é\n\t\"@  \x85\x0b", "'s", "<|endoftext|>", "日本", "\x1c"]
    for _ in range(40):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(100)]
        ids, cuts = words.encode(pa.array(texts))
        for i, text in enumerate(texts):
            assert ids[cuts[i] : cuts[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_best_fit_takes_the_tightest_bin():
    bins = OpenBins(10)
    for left in (7, 3, 5, 5):
        bins.put(left, (left,))
    assert bins.tightest(4)[0] == 5
    assert bins.tightest(6)[0] == 7
    assert bins.tightest(6) is None
    assert bins.tightest(1)[0] == 3


def test_best_fit_against_a_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(0, 60))], np.int64)
        got, _ = best_fit_decreasing(sizes, 20)
        left: list[int] = []
        for size in sorted(sizes.tolist(), reverse=True):
            fits = [i for i, x in enumerate(left) if x >= size]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= size
            else:
                left.append(20 - size)
        assert len(set(got.tolist())) == len(left)
