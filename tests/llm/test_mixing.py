import math
import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing
from tidemark.llm.mixing import KEY_BITS, _key, exponent, mix, mixed_rows, plan


def entropy(weights):
    return -sum(w * math.log(w) for w in weights)


def temper(shares, e):
    raised = [s**e for s in shares]
    return [x / sum(raised) for x in raised]


def bisected(shares, target=None, most=4.0, budget=None):
    """The exponent by plain bisection, and the passes of each source."""
    target = (entropy(shares) + math.log(len(shares))) / 2 if target is None else target

    def repeats(e):
        ratio = [w / s for w, s in zip(temper(shares, e), shares, strict=True)]
        return [r * (1 / min(ratio) if budget is None else budget) for r in ratio]

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if entropy(temper(shares, mid)) <= target + 1e-12 and max(repeats(mid)) <= most * (1 + 1e-12) else (mid, hi)
    return hi, repeats(hi)


def sources(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")


@pytest.mark.parametrize("options", [{}, {"most_repeats": 2.0}, {"target_entropy": 0.9, "most_repeats": 1e9}, {"budget_share": 0.5}, {"budget_share": 9.0}])
def test_exponent(spark, options):
    names = {"target_entropy": "target", "most_repeats": "most", "budget_share": "budget"}
    want, _ = bisected([0.7, 0.2, 0.1], **{names[k]: v for k, v in options.items()})
    assert exponent(sources(spark, [700, 200, 100, 0]), **options) == pytest.approx(want, abs=1e-9)


def test_ends_of_the_exponent(spark):
    assert exponent(sources(spark, [5])) == exponent(sources(spark, [])) == 1.0
    assert exponent(sources(spark, [5, 5, 5])) == 0.0
    assert exponent(sources(spark, [9, 1]), most_repeats=1.0) == pytest.approx(1.0)


def brute(docs, keys, budget_tokens=None):
    """Every pass (doc, epoch) by a walk over each source's permutations: docs are (id, source, tokens)."""
    own = defaultdict(list)
    for doc, source, n in docs:
        own[source].append((doc, n))
    tokens = {s: sum(n for _, n in d) for s, d in own.items()}
    total, names = sum(tokens.values()), sorted((s for s in own if tokens[s]), key=str)
    _, times = bisected([tokens[s] / total for s in names], budget=None if budget_tokens is None else budget_tokens / total)
    times = dict(zip(names, times, strict=True))
    out = []
    for s, rows in own.items():
        full = math.floor(times.get(s, 1.0) + 1e-9)
        out += [(d, e) for d, _ in rows for e in range(full)]
        left, open_ = max(0.0, times.get(s, 1.0) - full) * tokens[s], times.get(s, 1.0) - full > 0
        by_key = defaultdict(list)
        for d, n in rows:
            by_key[keys[d, full]].append((d, n))
        for k in sorted(by_key):
            left -= sum(n for _, n in by_key[k])
            if left < 0 or not open_:
                break
            out += [(d, full) for d, _ in by_key[k]]
    return Counter(out)


def keys_of(df, epochs=12):
    from pyspark.sql import functions as F

    return {(r.doc_id, r.e): r.k for r in df.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(epochs))).alias("e")).select("doc_id", "e", _key(0, F.col("e"), F.col("doc_id")).alias("k")).collect()}


@pytest.mark.parametrize("block", [1, 4, 1000])
@pytest.mark.parametrize("budget", [None, 30_000, 400_000])
def test_passes_against_a_walk(documents, monkeypatch, block, budget):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    docs = [(r.doc_id, r.source, len(re.findall(r"\S+", r.text))) for r in documents.collect()]
    got = mix(documents, budget_tokens=budget).collect()
    assert Counter((r.doc_id, r.epoch) for r in got) == brute(docs, keys_of(documents), budget)
    assert all(r.epoch < r.repeats for r in got) and {r.doc_id: r.n_tokens for r in got}.items() <= {d: n for d, _, n in docs}.items()
    if budget:
        assert sum(r.n_tokens for r in got) <= budget + 1


def test_places(documents):
    """A place is how far the source has come; so sources keep their weights along the whole order."""
    keys, cuts = keys_of(documents), {r.source: r for r in plan(documents)[1].collect()}
    rows = sorted(mix(documents).collect(), key=lambda r: (r.block, r.place, r.doc_id))
    assert all(r.place == pytest.approx(min(1.0, (r.epoch + keys[r.doc_id, r.epoch] / 2**KEY_BITS) / cuts[r.source].repeats)) for r in rows)
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    assert sum(c.weight for c in cuts.values()) == pytest.approx(1.0)
    for source in cuts:
        places = [i / len(rows) for i, r in enumerate(rows) if r.source == source]
        if len(places) >= 40:
            assert abs(sum(places) / len(places) - 0.5) < 0.15


def test_many_sources(spark):
    """More sources than are ever collected or broadcast as one literal."""
    from pyspark.sql import functions as F

    docs = spark.range(150_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id")).alias("source"))
    assert mix(docs).count() == 150_000


def test_mixed_rows_agree_with_the_plan(documents):
    want = Counter(r.doc_id for r in mix(documents).collect())
    rows = mixed_rows(documents)
    assert rows.columns == documents.columns
    assert Counter(r.doc_id for r in rows.collect()) == want


def test_odd_rows(make_docs, odd, spark):
    from pyspark.sql import functions as F

    docs = make_docs([*odd, (3, "word"), (None, "no id")], clash=True)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    want = Counter(r.doc_id for r in docs.collect())
    passed = Counter(r.doc_id for r in mixed_rows(docs).collect())
    assert all(passed[d] >= n for d, n in want.items()), "no document is lost without a budget"
    assert mix(make_docs([])).collect() == []
    assert mixed_rows(make_docs([None, ""])).count() == 2


def test_every_inner_name_may_clash(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs(["a b", "c"])
    for name in ("_source", "_repeats", "_full", "_rest", "_weight", "_cut_key", "_cut_block", "own", "id", "of", "times", "full", "end", "cut", "place", "block", "epoch", "a.b"):
        docs = docs.withColumn(name, F.lit(7))
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns and {v for r in rows.collect() for v in r[5:]} == {7}


def test_no_python_on_executors(documents):
    assert not re.search("Python|Arrow|Pandas", mixed_rows(documents)._jdf.queryExecution().toString())
