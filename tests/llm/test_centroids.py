import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.centroids import KdTree, _dominated, _squares, cluster_vectors

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16, rounds=3, dimensions=64):
    """The rounds in plain integers, vector by vector."""
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)].append(v)
        centroids = [tuple(sum(x) // len(m) for x in zip(*m, strict=True)) if m else c for m, c in zip(members, centroids, strict=True)]
    out = [(i, near(v), far(v, centroids[near(v)])) for i, v in kept]
    part = {c: sum(d for _, x, d in out if x == c) for c in range(len(centroids))}
    return sorted(((i, c, d, part[c], sum(part.values()), list(centroids[c])) for i, c, d in out), key=repr)


def run(df, **options):
    return sorted((tuple(r) for r in cluster_vectors(df, **options).collect()), key=repr)


def vectors(n, seed, clusters=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, 64))
    return [(i, (middle[i % clusters] + rng.normal(0, 0.2, 64)).astype(np.float32).tolist()) for i in range(n)]


def test_as_vector_by_vector(spark):
    rows = vectors(400, 1)
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_odd_rows(spark):
    v = vectors(30, 2)
    rows = v + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (None, [0.5] * 64), (3, v[4][1]), (3, v[3][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("points", F.lit(2))
    assert run(df) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [0.0] * 64)], [(7, [1.0] * 64)], [(i, [2.0] * 64) for i in range(100)]])
def test_few_or_equal_vectors(spark, rows):
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_very_large_components_are_held(spark):
    found = run(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], SCHEMA), k=1)
    assert [r[2] for r in found] == [1 << 60] * 2


@pytest.mark.parametrize("dimensions, k", [(1, 3), (2, 5), (3, 8), (64, 16)])
def test_tree_assigns_as_brute_force(dimensions, k):
    rng = np.random.default_rng(dimensions)
    for top in (3, 50, 1 << 26):
        points, centroids = rng.integers(-top, top + 1, (700, dimensions)), rng.integers(-top, top + 1, (k, dimensions))
        tree, order = KdTree.build(points, leaf=4)
        tree = KdTree.from_bytes(tree.to_bytes(), dimensions)
        counts, sums, clusters = tree.assign(centroids)
        want = np.array([min(range(k), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(p, centroids[c], strict=True)), c)) for p in points])
        assert (clusters == want[order]).all() and (counts == np.bincount(want, minlength=k)).all()
        assert (sums == np.stack([points[want == c].sum(0) for c in range(k)])).all()
        assert len(tree.start) > 1 and (tree.stop - tree.start)[tree.left < 0].sum() == 700


def test_trees_prune_and_assign_whole_nodes():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1000, (4096, 2))
    centroids = np.array([(100, 100), (900, 900), (100, 900), (900, 100)])
    tree, _ = KdTree.build(points)
    low, high = tree.low, tree.high
    pruned = _dominated(centroids, _squares(low + high, 2 * centroids).argmin(1), low, high)
    assert 0.5 < (pruned.sum(1) == 3).mean() < 1 and not pruned[0].any()
    box = (low[:, None, :] <= points) & (points <= high[:, None, :])
    away = _squares(points, centroids)
    for node in range(0, len(low), 7):
        inside = box[node].all(1)
        assert not pruned[node][np.unique(away[inside].argmin(1))].any()
