"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from ._arrow import read_table
from .centroids import cluster_vectors
from .chat import maximal_conversations, render
from .collocations import collocations
from .fingerprints import fingerprint, fingerprint_string, lexicon, likeness, with_next
from .language_id import held_out, identify, train
from .media import decode_audio, encode_audio
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack_documents
from .secrets import KINDS, scan_secrets, span_list
from .substring_dedup import remove_repeated
from .suffix_dedup import remove_repeated_bytes
from .token_counts import count_tokens

WORD_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lexicon(docs)
    pairs = with_next(docs, lambda text: F.struct(text.alias("text"), fingerprint(text, kept).alias("hashes")))
    n = F.length("value.text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("value.text"), F.lit(1), n - half), F.substring(F.col("next_value.text"), F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), F.col("value.hashes").alias("own"), F.col("next_value.hashes").alias("following"), edited.alias("edited"))
    pairs = pairs.withColumn("changed", fingerprint(F.col("edited"), kept))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_string(F.col("own")).alias("fingerprint"),
        fingerprint_string(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    read = decode_audio(encode_audio(docs))
    # What the reader has found and verified: exact duration, frames, rate, checksums held and wrong, table against frames, seek offsets.
    parts = {"us": "duration_us", "frames": "n_frames", "hz": "hertz", "checked": "n_checked", "bad": "bad_checksums", "table": "table_agrees", "seek": F.crc32(F.concat_ws(",", "seek_offsets").cast("binary"))}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), value) for name, value in parts.items()])
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    live = F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(span_list("base_spans"), 256).alias("base_sha256"), span_list("spans").alias("spans"), live)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "repeats", "epoch", "block", "place")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal_conversations(read_table(spark, sf_dir, "conversations")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_TOKENIZER))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_near_dedup": op2_near_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_fingerprints": op4_fingerprints,
        "op5_media_columns": op5_media_columns,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_secret_scans": op7_secret_scans,
        "op8_mixing": op8_mixing,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_token_counts": op10_token_counts,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_centroids": op12_centroids,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
