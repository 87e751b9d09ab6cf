import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, pricing
from tidemark.operators.drift import align


def test_native_and_python_hashes_agree(spark):
    rng = random.Random(4)
    parts = ["2024-01-02T03:04:05Z", "2024-01-02", "Mon, 1 Jan 2024 00:00:00 GMT", "12ms", "3.5s", "0xdeadbeef", "/tmp/a/b", "/var/folders/x\"y", "123e4567-e89b-12d3-a456-426614174000", 'EXTERNAL_UNTRUSTED_CONTENT id=\\"0123456789abcdef\\"', "text", "  ", "\n", "12345", "x1", "é", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None]
    df = hashing.with_content_hash(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    for r in df.collect():
        assert (r.content_hash, r.masked_spans) == ((None, None) if r.t is None else hashing.hash_text(r.t))


def test_canonical_json():
    assert hashing.canonical_json('{"b": 1.0, "a": [1.5, {"z": null, "y": "é"}]}') == '{"a":[1.5,{"y":"é","z":null}],"b":1}'
    assert hashing.hash_text('{"a": 1, "b": 2}', True) == hashing.hash_text('{"b":2.0,"a":1}', True)
    assert hashing.hash_text("not json", True) == hashing.hash_text("not   json")


def test_temporary_paths_end_at_quotes():
    assert hashing.mask_text('{"dir":"/tmp/x","out":"Ran 2"}') == ('{"dir":"<TMP>","out":"Ran 2"}', 1)
    assert hashing.mask_text("order 123456") == ("order 123456", 0)
    assert hashing.mask_text("order 123456", True) == ("order <NUM>", 1)


def plain_simhash(text):
    import hashlib

    grams = {text[i : i + 4] for i in range(len(text) - 3)} if len(text) > 4 else {text} - {""}
    votes = [0] * 64
    for g in grams:
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        for bit in range(64):
            votes[bit] += 1 if h >> bit & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


@pytest.mark.parametrize("text", ["", "a", "abcd", "abcde", "hello world, hello", "é" * 10, "x" * 200])
def test_simhash(text):
    assert hashing.simhash(text) == plain_simhash(text)


def test_simhashes_of_many_texts(monkeypatch):
    """The worker's tables filled, full, and too small for the characters."""
    rng = random.Random(5)
    letters = "ab é日😀" + "".join(map(chr, range(0x400, 0x460)))
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "abc", "".join(map(chr, range(0x3000, 0xD7FF))), "x" * 5000]
    want = [plain_simhash(t) for t in texts]
    for most in (2_000_000, 500):
        monkeypatch.setattr(hashing._Grams, "MOST", most)
        hashing._met.clear()
        assert hashing.simhashes(texts) == want and hashing.simhashes(texts[::-1]) == want[::-1]
    every = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    assert hashing.simhashes([every, "again"])[1] == plain_simhash("again") and hashing._plain_simhash(every) == hashing.simhashes([every])[0]


@pytest.mark.parametrize("text", ["no volatile span", "2024-01-02T03:04:05Z and 5ms", "Mon, 01 Jan 2024 01:02:03 GMT", "at /tmp/x-1 0xdeadbeef", "123e4567-e89b-12d3-a456-426614174000", 'EXTERNAL_UNTRUSTED_CONTENT id="0123456789abcdef"', "12345678"])
def test_rules_that_are_not_tried_would_not_match(text):
    for integers in (False, True):
        want, n = text, 0
        for rule, token in hashing._RULES[integers]:
            want, k = rule.subn(token, want)
            n += k
        assert hashing.mask_text(text, integers) == (want, n)


def test_fingerprint_column(spark):
    row = spark.createDataFrame([("some text here",)], "t string").select(hashing.fingerprint(F.col("t")).alias("f"), hashing.hash_structured(F.col("t")).alias("h")).head()
    assert row.f == hashing.fingerprint_text("some text here") and row.h.hash == hashing.hash_text("some text here", True)[0]


def test_alignment_against_plain_search():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
        return out

    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        found, pairs = align(a, b)
        assert found == distance(a, b)
        assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
        assert [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert found == sum(i is None or j is None or a[i] != b[j] for i, j in pairs)


def test_alignment_prefers_pairs_then_removals():
    assert align(["a"], ["b"])[1] == [(0, 0)]
    assert align(["a", "b"], ["b", "a"])[0] == 2


def plain_alignment(a, b):
    """The way back through a whole table."""
    table = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = min(table[i][j] + (x != y), table[i][j + 1] + 1, table[i + 1][j] + 1)
    i, j, pairs = len(a), len(b), []
    while i or j:
        ways = [(i - 1, j - 1, (i - 1, j - 1), table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))] if i and j else []
        ways += [(i - 1, j, (i - 1, None), table[i - 1][j] + 1)] if i else []
        ways += [(i, j - 1, (None, j - 1), table[i][j - 1] + 1)] if j else []
        i, j, pair, _ = next(w for w in ways if w[3] == table[i][j])
        pairs.append(pair)
    return table[-1][-1], pairs[::-1]


@pytest.mark.parametrize("letters", ["ab", "abcdef"])
def test_alignment_takes_the_same_way_back(letters):
    rng = random.Random(3)
    for size in (0, 1, 5, 12, 60):
        for _ in range(30):
            a, b = ([rng.choice(letters) for _ in range(rng.randint(0, size))] for _ in range(2))
            assert align(a, b) == plain_alignment(a, b)


def test_alignment_of_long_sequences_in_little_memory():
    import tracemalloc

    rng = random.Random(4)
    a = [rng.choice("abcd") for _ in range(6000)]
    b = [x for x in a if rng.random() < 0.95] + ["z"] * 500
    tracemalloc.start()
    found, pairs = align(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and found == sum(i is None or j is None or a[i] != b[j] for i, j in pairs) >= 500


def test_prices(spark):
    table = pricing.price_table(spark, {"m": {"input": 1.0, "output": 2.0, "cache_read": 0.5}, "n": {"input": 3.0, "output": 4.0}})
    table = pricing.overlaid(table, pricing.price_table(spark, {"n": {"input": 5.0, "output": 6.0}}))
    events = spark.createDataFrame([(1, "m", 10, 1), (2, "n", 1, None), (3, "x/m", 1, 1), (4, "m", None, None), (5, None, 1, 1)], "i int, model string, tokens_in long, tokens_out long")
    got = {r.i: r.estimated_usd for r in pricing.estimate(events, table, cache_read=F.lit(2)).collect()}
    assert got == {1: 13.0, 2: 5.0, 3: None, 4: None, 5: None}


def test_price_notes():
    from datetime import datetime, timezone

    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    assert pricing.age_days("2024-01-01T00:00:00Z", now) == 60
    assert "over 30 days" in pricing.age_note("2024-01-01T00:00:00Z", now)
    assert pricing.age_note("2024-02-28T00:00:00Z", now).endswith("(2 day(s) old)")
    assert pricing.age_note(None) is None and pricing.age_note("bad") is None
    assert pricing.projected_monthly(0.028, 16) == pytest.approx(52.5)
    assert pricing.projected_monthly(1, 0) is None


def test_nearest_kept_ancestor_across_batches(spark):
    from tidemark.operators.joins import nearest_kept_ancestor

    rng = random.Random(6)
    rows = [(t, s, rng.randint(0, 12) if rng.random() < 0.8 else None, rng.random() < 0.4) for t in range(200) for s in range(rng.randint(1, 10))]
    table = {(t, s): (p, k) for t, s, p, k in rows}
    want = set()
    for t, s, p, _ in rows:
        seen, at = {s}, p
        while (t, at) in table and not table[t, at][1] and at not in seen:
            seen.add(at)
            at = table[t, at][0]
        want.add((t, s, at if (t, at) in table and at not in seen else None))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = nearest_kept_ancestor(spark.createDataFrame(rows, "trace long, span_id long, parent_id long, kept boolean"))
        got = {tuple(r) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
