import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names clash with made ones if asked for."""

    def make(texts, clash=False):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for name in ("text_hash", "kept", "score", "rejected", "spans", "component", "epoch", "n_tokens", "_key", "media", "payload", "rare", "key", "hub", "weight", "full", "rest", "repeats", "lang_pred", "cross_entropy", "found", "copy", "value"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Null, empty, white space only, one word, no letters, very long, and ties.
ODD = [None, "", " \t\n", "word", "1234 !!", "same text again and again here", "same text again and again here", "x " * 60_000, "é" * 50_000, "a b\x1cc 日本 😀"]


@pytest.fixture(scope="session")
def odd():
    return ODD
