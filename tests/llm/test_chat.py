import random
import re
from collections import defaultdict

from tidemark.llm.chat import maximal_conversations, render

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    found = defaultdict(set)
    for conv, *turn in rows:
        found[conv, tuple(turn) if conv is None else ()].add(tuple(turn))
    low = lambda v: (v is not None, v)
    lists = {c: tuple((r, t) for _, r, t in sorted(own, key=lambda x: tuple(map(low, x)))) for c, own in found.items()}
    out = {}
    for conv, own in lists.items():
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in lists.values())
        first = min((c for c, o in lists.items() if o == own), key=lambda c: (c[0] is not None, c[0] or 0))
        if not longer and first == conv:
            out[conv] = "".join(f"<|{r or ''}|>\n{t or ''}\n<|end|>\n" for r, t in own)
    return sorted(((c, text) for (c, _), text in out.items()), key=str)


def got(df):
    return sorted(((r.conv_id, r.rendered) for r in render(maximal_conversations(df)).collect()), key=str)


def test_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got(df) == brute(list(map(tuple, df.collect())))


def test_snapshots(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(150):
        rows += [(conv, t, "ua"[t % 2], f"t{rng.randint(0, 1)}") for t in range(rng.randint(1, 6))]
    rows += [(200, t, "u", "long") for t in range(300)] + [(201, t, "u", "long") for t in range(299)] + [(202, t + 7, "u", "long") for t in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (2, 0, None, ""), (3, 0, "", None), (None, 0, "u", "x"), (None, 1, "u", "y"), (4, None, "u", "x"), (5, 0, "u", "x"), (5, 0, "u", "x"), (5, 0, "u", "z")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as prefix", "1 as place", "2 as n_turns", "'k' as kept_id")
    assert got(df) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_no_python_on_executors(spark, sf_dir):
    df = render(maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
