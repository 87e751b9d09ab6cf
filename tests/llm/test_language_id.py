import zlib

import pytest

from tidemark.llm.language_id import KneserNey, SortedHashes, held_out, identify, symbols_of, train
from tidemark.llm.queries import op1_language_id


def test_held_out_accuracy(spark, documents, sf_dir):
    rows = op1_language_id(spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in documents.collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 2


@pytest.fixture(scope="module")
def model():
    fit = [["the cat sat on the mat and the dog ran " * 3] * 8, ["der hund und die katze sind im garten " * 3] * 8]
    model = KneserNey(["de", "en"], fit[::-1])
    model.calibrate([["und der garten ist im hund"] * 10, ["the dog and the cat"] * 10])
    return model


def logs_of(model, text):
    """Log-probabilities of a text's symbols, a row each."""
    s = symbols_of([text], model.table())
    return model.log_probability(s.hashes(0, len(s.weight), model.order)).astype(float)


def test_probabilities_sum_to_one(model):
    import numpy as np

    for context in ("a", "t", "th", "the d", "qzzx", "the dog r"):
        # Every letter, one never seen, and what isn't a letter.
        total = sum(np.exp(logs_of(model, context + c)[-1]) for c in [*model.letters, "щ", "."])
        assert total == pytest.approx([1, 1], abs=1e-4), context


def plain_kneser_ney(texts, order, alphabet):
    """log P(symbol | symbols before) by recursion over dictionaries; texts are lists of symbols, None stands before them."""
    from collections import Counter, defaultdict
    from math import log

    grams = {order: Counter()}
    for t in texts:
        padded = [0] * (order - 1) + t
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    sums, kinds = {}, {}
    for k, own in grams.items():
        sums[k], kinds[k] = defaultdict(int), defaultdict(int)
        for g, n in own.items():
            sums[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
    discounts = {}
    for k, own in grams.items():
        ones, twos = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
        discounts[k] = min(max(ones / max(1, ones + 2 * twos), 0.1), 0.95)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / alphabet
        total = sums[k].get(gram[:-1], 0)
        if not total:
            return lower
        return max(grams[k][gram] - discounts[k], 0) / total + discounts[k] * kinds[k][gram[:-1]] / total * lower

    return lambda symbols: [log(p(tuple(([0] * (order - 1) + symbols[: i + 1])[-order:]))) for i in range(len(symbols))]


def as_symbols(text, letters):
    import re

    return [0 if not c.isalpha() else c if c in letters else "unseen" for c in re.sub(r"[^\w]+|_+", " ", text.lower()).lstrip()]


def test_against_plain_kneser_ney():
    import random

    rng = random.Random(4)
    texts = [["".join(rng.choice(letters + "  ") for _ in range(rng.randint(1, 60))) for _ in range(25)] for letters in ("abcde", "cdefg한글", "aeiouxyz")]
    model = KneserNey(["a", "b", "c"], texts)
    assert len(model.models) == 1
    for lang, own in enumerate(texts):
        want = plain_kneser_ney([as_symbols(t, model.letters) for t in own], 5, model.alphabet)
        for probe in ["abc cde", "xyz한글 q", *own[:5], "aeiou" * 8]:
            assert logs_of(model, probe)[:, lang] == pytest.approx(want(as_symbols(probe, model.letters)), abs=1e-4)


def test_groups_of_languages_don_t_change_the_models(monkeypatch):
    import numpy as np

    from tidemark.llm import language_id

    texts = [["the cat sat"], ["der hund lief"], ["le chat dort"]]
    together = logs_of(KneserNey(list("abc"), texts), "the hund dort")
    monkeypatch.setattr(language_id, "TOGETHER", 1)
    assert np.allclose(logs_of(KneserNey(list("abc"), texts), "the hund dort"), together, atol=1e-6)


def test_large_alphabets(make_docs):
    """Over 5,000 letters: Korean after Chinese isn't one unseen symbol."""
    import random

    rng = random.Random(9)
    han, hangul = [chr(0x4E00 + i) for i in range(5000)], [chr(0xAC00 + i) for i in range(900)]
    texts = ["".join(rng.choice(own[: len(own) * 4 // 5] if i % 9 else own) for _ in range(600)) for i, own in enumerate([han, hangul] * 40)]
    model = KneserNey(["ko", "zh"], [texts[1::2], texts[::2]])
    assert set(model.letters) == set("".join(texts)) and len(model.letters) > 5000
    rows = identify(make_docs(["".join(rng.choices(hangul, k=50)), "".join(rng.choices(han, k=50))]), model).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id)] == ["ko", "zh"]


def test_a_language_of_long_texts_only_is_learned(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([("the cat sat on the mat " if i % 2 else "der hund lief im garten ") * (3000 if i % 2 else 3) for i in range(60)])
    model = train(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de")))
    assert model.languages == ["de", "en"]


def test_more_than_a_thousand_languages(spark):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i // 2)} " * 4, f"l{i:04d}") for i in range(1001)], "doc_id long, text string, lang string")
    model = train(docs)
    assert len(model.languages) == 1001
    rows = {r.doc_id: r.lang_pred for r in identify(docs.where("doc_id % 100 = 0"), model).collect()}
    assert all(rows[i] == f"l{i:04d}" for i in rows)


def test_odd_texts(make_docs, odd, model):
    rows = {r.doc_id: r for r in identify(make_docs([*odd, "the cat and the dog", "der hund"], clash=True), model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 4)] == ["und"] * 4
    assert all(rows[i].rejected and rows[i].score == 0 for i in (0, 1, 2, 4))
    assert rows[len(odd)].lang_pred == "en" and rows[len(odd) + 1].lang_pred == "de"
    assert rows[5].score == rows[6].score
    assert not rows[len(odd)].rejected


def test_text_of_another_script_is_rejected(make_docs, model):
    assert identify(make_docs(["это совсем другой язык и буквы " * 5]), model).head().rejected


def test_without_labels_all_is_undetermined(make_docs, spark):
    from pyspark.sql import functions as F

    docs = make_docs(["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    rows = identify(docs, train(docs)).collect()
    assert [r.lang_pred for r in rows] == ["und", "und"]
    assert identify(make_docs([]), train(docs)).collect() == []


def test_only_learnable_rows_are_seen(make_docs):
    docs = make_docs(["alpha beta"] * 20 + [(None, "gamma")])
    model = train(docs.where(~held_out()))
    assert "g" not in model.letters


def test_sorted_hashes():
    import numpy as np

    table = SortedHashes.of(np.array([5, 9, 1], np.uint64), np.array([[5.0], [9.0], [1.0]]))
    at, found = table.find(np.array([1, 2, 9], np.uint64))
    assert found.tolist() == [True, False, True]
    assert table.rows[at[0], 0] == 1 and table.rows[at[2], 0] == 9


def test_rows_that_repeat_an_id(spark):
    """A language is learned from whatever ids its rows repeat, and no more rows than the bound reach the driver."""
    from pyspark.sql import functions as F

    from tidemark.llm.language_id import _sample, train

    en = spark.range(300).select("id", F.concat_ws(" ", F.lit("the cat and the dog number"), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    for i in (7, 259):
        fr = spark.range(50_000).select(F.lit(i).cast("long").alias("id"), F.concat_ws(" ", F.lit("le chat et le chien"), F.col("id").cast("string")).alias("text"), F.lit("fr").alias("lang"))
        same = spark.range(5_000).select(F.lit(i).cast("long").alias("id"), F.lit("der Hund und die Katze im Haus").alias("text"), F.lit("de").alias("lang"))
        docs = en.unionByName(fr).unionByName(same).withColumnRenamed("id", "doc_id")
        assert {r["lang"]: r["count"] for r in _sample(docs, "doc_id", "text", "lang", 100, 400).groupBy("lang").count().collect()} == {"en": 100, "fr": 100, "de": 1}
    assert train(docs, sample_docs=50).languages == ["de", "en", "fr"]


def test_very_many_languages(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.llm import language_id

    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 2_000)
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(w), F.format_string("%x", F.col("id") % 2_000)) for w in ("ab", "cd")]).alias("text"), F.format_string("l%04d", F.col("id") % 2_000).alias("lang"))
    taken = language_id._sample(docs, "doc_id", "text", "lang", 400, 4_000)
    assert taken.count() == 2_000 and taken.select("lang").distinct().count() == 2_000
