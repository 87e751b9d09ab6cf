"""Hashes and fingerprints of all documents, plain or not, against the rules in Python."""

import hashlib
import re
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.functions import hashing
from tidemark.queries import mask_counts, normalize_text, simhash_docs, simhash_turns

ODD = [None, "", "café  x", "café x", "a b c", "١٢٣٤٥ 123456", "5µs 12ms\tnach 2024-01-02", "plain 123456 12ms", "a\x1cb"]


@pytest.fixture(scope="module")
def folder(sf_dir, tmp_path_factory):
    """The documents, with odd texts and a null one."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet")
    extra = [{"doc_id": 1_000_000 + i, "text": t, "lang": "fr", "source": "s", "n_chars": len(t or "")} for i, t in enumerate(ODD)]
    to = tmp_path_factory.mktemp("whole")
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(extra, schema=docs.schema)]), to / "documents.parquet")
    return str(to)


def texts(folder):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}


def short(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_normalize_text(spark, folder):
    want = {i: None if t is None else short(re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip()) for i, t in texts(folder).items()}
    rows = normalize_text(spark, folder).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: r.normal_hash for r in rows} == want


def test_mask_counts(spark, folder):
    want = {i: (None, None) if t is None else hashing.hash_text(t, integers=True) for i, t in texts(folder).items()}
    rows = mask_counts(spark, folder).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.masked_hash, r.spans) for r in rows} == want
    assert sum(not (t or "").isascii() for t in texts(folder).values()) > 50


def test_fingerprints(spark, folder, sf_dir):
    want = {i: None if t is None else hashing.fingerprint_text(t) for i, t in texts(folder).items()}
    rows = simhash_docs(spark, folder).collect()
    assert len(rows) == len(want)
    assert {r.doc_id: r.fingerprint for r in rows} == want
    assert {"conv_id", "turn", "fingerprint"} == set(simhash_turns(spark, sf_dir).columns)
