import sys
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def stages(spark, documents, sf_dir):
    import corpus_pipeline
    from tidemark.llm._arrow import materialise

    out, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_columns_and_order(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scans", "mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_decisions_take_effect(stages):
    from tests.llm.test_near_dedup import brute
    from tests.llm.test_secrets import brute as secrets

    rows = [{r.doc_id: r for r in s.collect()} for s in stages[:5]]
    assert len(rows[0]) - len(rows[1]) <= 3
    kept = {d for d, _, _, stays in brute([(d, r.text) for d, r in rows[1].items()], 5) if stays}
    assert set(rows[2]) == kept
    assert set(rows[3]) == kept and not any(secrets(r.text.replace("[SECRET]", "*")) for r in rows[3].values())
    assert {d: r.text for d, r in rows[3].items() if not secrets(rows[2][d].text)} == {d: r.text for d, r in rows[2].items() if not secrets(r.text)}
    passes = Counter(r.doc_id for r in stages[4].collect())
    assert set(passes) == kept and max(passes.values()) > 1
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == kept
    assert Counter(r.doc_id for r in packed if r.piece == 0) == passes


def test_run(spark, sf_dir, stages):
    import corpus_pipeline

    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == Counter(map(tuple, stages[5].select("doc_id", "piece", "ids_crc32").collect()))


def test_odd_rows_and_clashing_columns(spark, make_docs, odd, sf_dir):
    import corpus_pipeline
    from tidemark.llm._arrow import materialise

    docs = make_docs([*odd, (None, "no id at all"), (3, "word")], clash=True)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = materialise(stage(spark, out, sf_dir))
        assert out.columns == docs.columns
    rows = out.collect()
    assert {r.score for r in rows} == {"x"} and {r.weight for r in rows} == {"x"}
    assert {r.doc_id for r in rows} == {None, 3, 5, 7, 8, 9}
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []


@pytest.mark.parametrize("place", range(4))
def test_columns_of_any_name(spark, make_docs, sf_dir, place):
    import corpus_pipeline
    from pyspark.sql import functions as F

    _, stage = corpus_pipeline.STAGES[place]
    docs = make_docs(["some words of a text", "password = hunter22 and more"])
    names = ["a.b", "a`b", "Score", "_own_score", "own", "Lang_Pred", "c0", "gone"]
    docs = docs.select("*", *[F.lit(f"v{i}").alias(n) for i, n in enumerate(names)])
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[len(docs.columns) - len(names) + i] == f"v{i}" for r in rows for i in range(len(names)))


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "tidemark.llm" in sys.modules
