import random
import re
import time
from collections import Counter, defaultdict

import pytest

from tidemark.llm import near_dedup
from tidemark.llm._arrow import SHUFFLES_REMOVED
from tidemark.llm.near_dedup import near_duplicates


def brute(docs, size, percent=80):
    sets = {}
    for doc, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = defaultdict(list)
    for doc in sorted(sets):
        for other, n in Counter(o for s in sets[doc] for o in holders[s]).items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                a, b = find(doc), find(other)
                top[max(a, b)] = min(a, b)
        for s in sets[doc]:
            holders[s].append(doc)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def got(df, size):
    return sorted(tuple(r) for r in near_duplicates(df, shingle=size).collect())


def near_group(n, seed, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(words)] = f"e{rng.randint(0, 30)}"
        yield " ".join(text)


@pytest.mark.parametrize("size", [4, 5])
def test_documents(documents, size):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents, size) == brute(docs, size)


def test_large_group_of_near_copies(make_docs, monkeypatch):
    """Short limits make all ways of meeting run: hubs, short lists, frequent and rare shingles."""
    monkeypatch.setattr(near_dedup, "LIST", 4)
    monkeypatch.setattr(near_dedup, "RARE", 3)
    texts = [*near_group(60, 1), *near_group(40, 2), *near_group(3, 3)]
    random.Random(4).shuffle(texts)
    assert got(make_docs(texts), 4) == brute(list(enumerate(texts)), 4)


def template_pages(n, seed, own=12):
    """Pages of 100 common words, three of twelve sections of 40 words, and a list of words of their own."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    common, sections = words(100), [words(40) for _ in range(12)]
    return [" ".join([common, *(sections[i] for i in sorted(rng.sample(range(12), 3))), words(rng.randint(1, own))]) for _ in range(n)]


def counted(monkeypatch):
    """Counts the pairs that are compared on full sets."""
    seen, links = [], near_dedup._links

    def counting(pairs, sets, percent):
        pairs = near_dedup.detached(pairs)
        seen.append(pairs.select("hub", "doc_id").distinct().count())
        return links(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "_links", counting)
    return seen


@pytest.mark.parametrize("n, own", [(500, 12), (300, 60)])
def test_pages_of_a_template_are_not_all_compared(make_docs, monkeypatch, n, own):
    """Components of pages with the same sections, without comparing all pages of the template (before: 80,942 pairs for 500)."""
    texts = template_pages(n, n, own)
    seen = counted(monkeypatch)
    assert got(make_docs(texts), 4) == brute(list(enumerate(texts)), 4)
    assert sum(seen) < 30_000


def test_classes_that_are_similar_meet(make_docs, monkeypatch):
    """Templates that differ in a few words: heads link, and members of one class that only reach the other's head."""
    monkeypatch.setattr(near_dedup, "LIST", 4)
    monkeypatch.setattr(near_dedup, "RARE", 2)
    rng = random.Random(3)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    common, extra = words(100), [words(12) for _ in range(5)]
    texts = [" ".join(common + sum((extra[i] for i in rng.sample(range(5), rng.randint(0, 3))), []) + words(rng.randint(0, 25))) for _ in range(150)]
    assert got(make_docs(texts), 4) == brute(list(enumerate(texts)), 4)


def test_odd_texts(make_docs, odd):
    texts = [*odd, "A B c", "a b C"]
    assert got(make_docs(texts, clash=True), 4) == brute(list(enumerate(texts)), 4)


def test_row_without_id_is_kept(make_docs):
    rows = near_duplicates(make_docs([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")])).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] and not kept[2]
    assert None in kept


def test_repeated_rows(make_docs):
    rows = got(make_docs([(3, "one two three four five")] * 3), 4)
    assert rows == [(3, 2, 3, True)] * 3


def test_empty_table(make_docs):
    assert got(make_docs([]), 4) == []


def test_components_of_chains(spark):
    from tidemark.llm._components import connected_components

    rng = random.Random(7)
    nodes = list(range(200))
    rng.shuffle(nodes)
    links = [(nodes[i], nodes[i + 1]) for i in range(120)] + [(nodes[150], nodes[i]) for i in range(151, 180)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {found[n] for n in nodes[:121]} == {min(nodes[:121])}
    assert {found[n] for n in nodes[150:180]} == {min(nodes[150:180])}


def test_files_of_shuffles_go_and_few_rows_make_few_files(make_docs, spark, tmp_path):
    """Before: each step of some eighty left its shuffles' files and a checkpoint of 50 parts."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", SHUFFLES_REMOVED)}
    context = spark.sparkContext
    folder, disk = context._jsc.sc().getCheckpointDir().get(), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(f.startswith("shuffle_") for f in disk.getAllFiles().mkString("\n").replace("/", "\n").split("\n"))
    texts = list(near_group(60, 5))
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setCheckpointDir(str(tmp_path))
    try:
        before = shuffled()
        found = near_duplicates(make_docs(texts), 4)
        ends = time.time() + 20
        while shuffled() - before > 100 and time.time() < ends:  # they go in the background
            time.sleep(0.5)
        left, parts = shuffled() - before, Counter(p.parent for p in tmp_path.rglob("part-*"))
        assert spark.conf.get(SHUFFLES_REMOVED, None) == held[SHUFFLES_REMOVED]
        assert [sorted(map(tuple, found.collect())) for _ in range(2)] == [brute(list(enumerate(texts)), 4)] * 2
    finally:
        context.setCheckpointDir(folder.rpartition("/")[0])
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert left <= 100
    assert sum(n <= 8 for n in parts.values()) > 0.8 * len(parts)
