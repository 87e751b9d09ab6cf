import random

import pytest

from tidemark.llm.queries import PIECE_TOKENIZER, tokenizer_path
from tidemark.llm.token_counts import SPACE, PieceCounter, count_tokens, pieces_of_model

PATH = tokenizer_path(PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0), *pieces_of_model(PATH), *((f"<0x{i:02X}>", -1e9) for i in range(256))]
    unigram = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    return lambda text: len(unigram.encode(SPACE + text.replace(" ", SPACE), add_special_tokens=False).ids) if text else 0


def test_documents(documents, library):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = count_tokens(documents, PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {d: library(t) for d, t in texts.items()}


def test_odd_texts(make_docs, odd, library):
    texts = [*odd, "  two  spaces ", "▁ ▁▁x", "line\n\nline\t"]
    rows = count_tokens(make_docs(texts, clash=True), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library(t or "") for i, t in enumerate(texts)}
    assert count_tokens(make_docs([]), PATH).collect() == []


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_tie_rules(byte_fallback):
    from tokenizers import Tokenizer, models

    rng = random.Random(1)
    for _ in range(100):
        pieces = [(p, -float(rng.randint(1, 3))) for p in sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)})]
        vocabulary = [("<unk>", -50.0), *pieces, *((f"<0x{i:02X}>", -50.0) for i in range(256 * byte_fallback))]
        unigram = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
        counter = PieceCounter(pieces, byte_fallback)
        counter.unknown = -60.0
        for _ in range(20):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
            assert counter.best_path(text)[0] == len(unigram.encode(text).ids), (pieces, text)
