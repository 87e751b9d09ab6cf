import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as module
from tidemark.llm.collocations import Shard, collocations

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", text)]


def plain(rows, least=30, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for n in (1, 2, 3, 4):
                f.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in candidates.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                inside[lang, p[i : i + n]] = max(inside[lang, p[i : i + n]], a)
    rows = []
    for (lang, p), a in candidates.items():
        if 100 * inside[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out, rank = set(), Counter()
    for lang, score, a, p, l, r in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.add((lang, rank[lang], p.decode(), -a, l, r, total[lang], -score))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("phrase", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("n", F.lit(3))
    found = collocations(df.repartition(3), **options).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in ("New", "é", "z") for i in range(6)] + ["\x1c", "a b"]
    fixed = [" ".join(rng.choice(words) for _ in range(k)) for k in (2, 3, 4, 4, 6)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for p in parts), rng.choice(["en", "fr", None])))
    return rows


@pytest.mark.parametrize("least, top", [(5, 2000), (3, 7), (30, 2000)])
def test_as_counted_plainly(spark, least, top):
    rows = corpus(least)
    found = run(spark, rows, least=least, top=top)
    assert found == plain(rows, least, top) and (found or least == 30)


def test_small_shards_and_without_the_filter(spark, monkeypatch):
    rows = corpus(1)
    monkeypatch.setattr(module, "SHARD_BYTES", 200)
    want = plain(rows, 4)
    assert run(spark, rows, least=4) == want
    monkeypatch.setattr(module, "FILTER_PAIRS", 0)
    assert run(spark, rows, least=4) == want


def test_odd_texts(spark, odd):
    rows = [(t, None) for t in odd] + [("a a a a a. a a", "x"), ("", "x"), (".,;", "y"), ("b", "z")]
    for least in (1, 2, 5):
        assert run(spark, rows, least=least) == plain(rows, least)
    assert run(spark, []) == set()


def test_repeats_overlap(spark):
    found = run(spark, [("go " * 40, "en")])
    assert found == plain([("go " * 40, "en")])


def test_suffixes_are_in_order():
    rng = random.Random(2)
    text = "".join(rng.choice(["a ", "b ", "c ", ". ", "dd "]) for _ in range(500)) + "\n"
    shard = Shard(np.frombuffer(text.encode(), np.uint8))
    lists = [w for w in pieces(text) if w]
    want = Counter(tuple(w[i : i + 4]) for w in lists for i in range(len(w)))
    names = shard.texts.to_pylist()
    suffix = lambda p: tuple(names[w - 1] for w in shard.words[p : p + 4][: int(np.append(shard.words[p : p + 4], 0).argmin())])
    keys = [tuple(shard.words[p : p + len(suffix(p))]) for p in shard.suffixes.tolist()]
    assert Counter(suffix(p) for p in shard.suffixes.tolist()) == want
    shared = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:], strict=False)]
    assert shard.shared[1:].tolist() == shared and len(set(keys)) == sum(s < max(len(a), len(b)) for s, a, b in zip([0, *shared], [()] + keys, keys, strict=False))
