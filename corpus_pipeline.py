"""The corpus pipeline: language ID, near-dedup, secret scans, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; all but the last return the columns of documents.  In every stage columns beyond
those it works on stay as they are, whatever their names, ties go to the least id, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._arrow import read_table, written
from tidemark.llm.language_id import held_out, identify, train
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import WORD_TOKENIZER, tokenizer_path
from tidemark.llm.secrets import redact

#: No stage's result can be expressed in SQL: models, MinHash and a tokenizer decide.
ORACLE_SQL = None


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """The columns that a stage works on by their names, all others in one struct by their places: no name of theirs is ever read."""
    places = {name: docs.columns.index(name) for name in names}
    placed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    others = [F.col(f"c{i}") for i in range(len(docs.columns)) if i not in places.values()]
    return placed.select(*[F.col(f"c{i}").alias(name) for name, i in places.items()], F.struct(F.lit(0).alias("c"), *others).alias("own"))


def _together(found: DataFrame, docs: DataFrame, *names: str) -> DataFrame:
    """The columns of docs in their order, those of ``names`` as a stage left them."""
    places = {docs.columns.index(name): name for name in names}
    return found.select(*[(F.col(places[i]) if i in places else F.col("own")[f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects; documents without a language get the predicted one.

    Null, empty and letterless texts are rejected; very long ones are judged whole;
    repeated rows are judged alike, and rows without an id as any other.
    """
    names = ("doc_id", "text", "lang")
    known = _apart(docs, *names)
    model = train(known.where(~held_out()))
    found = identify(known, model).where(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return _together(found, docs, *names)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Null and wordless texts are like nothing and stay; so do rows without an id; of
    repeated rows of one id all stay or all go.
    """
    names = ("doc_id", "text")
    known = _apart(docs, *names)
    gone = near_duplicates(known).where(~F.col("kept")).select("doc_id").distinct()
    return _together(known.join(gone, "doc_id", "left_anti"), docs, *names)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the value of every secret; n_chars follows the text.

    Null texts stay null, with null n_chars; empty ones stay empty; every row stays.
    """
    names = ("doc_id", "text", "source", "n_chars")
    known = redact(_apart(docs, *names)).withColumn("n_chars", F.length("text").cast("long"))
    return _together(known, docs, *names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come near their target weights; every document stays at least once.

    Null and empty texts weigh nothing; rows without a source are one source; repeated
    rows are passed equally often.
    """
    return mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixture into sequences of at most 2048 tokens.

    Null and empty texts are one end token; longer texts than a sequence are cut; every
    repeated row is packed for itself.
    """
    return pack_documents(docs, tokenizer_path(WORD_TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
