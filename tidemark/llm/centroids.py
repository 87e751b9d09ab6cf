"""Exact k-means over integers, by kd-tree filtering.

Vectors are put into kd-trees once, blocks of at most ``BLOCK`` vectors of a partition;
the trees are checkpointed and serve every round.  A node holds the count of its vectors,
their integer sums and their bounding box.  A round sends the centroids (their number is
a parameter, so they are bounded) down each tree:

* of a node's candidates the one nearest to the middle of the box is compared with the
  others; those that are farther from every point of the box, strictly, are pruned;
* a node with one candidate left is assigned whole, by its count and sums;
* leaves with several are resolved vector by vector, ties to the smaller number.

All arithmetic is on integers, so results don't depend on the order of rows or tasks.
A task adds up its trees and sends one row a centroid.

Defined results: vectors with another number of components, or with null or non-finite
ones, are left out; components beyond +-2**27 after scaling count as that, so that
squared distances fit 64 bits; vectors without an id are assigned but start no centroid;
rows that repeat an id are vectors for themselves, and first centroids of one id come in
the order of their components; with fewer vectors than centroids there are fewer
centroids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bounded_batches, column, materialise, releasing

CENTROIDS, ROUNDS, SCALE, DIMENSIONS = 16, 3, 64, 64
#: Vectors of a tree and of a leaf at most.
BLOCK, LEAF = 8192, 32
_LIMIT = 1 << 27


class KdTree:
    """A kd-tree as arrays: node i's vectors are order[start[i]:stop[i]], its children left[i] and left[i] + 1 (or -1)."""

    FIELDS = ("points", "start", "stop", "left", "low", "high", "sums")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[KdTree, np.ndarray]:
        """The tree and the order in which it holds the vectors."""
        order = np.arange(len(points))
        start, stop, left = [0], [len(points)], [-1]
        at = 0
        while at < len(start):
            a, b = start[at], stop[at]
            own = points[order[a:b]]
            wide = own.max(0) - own.min(0)
            axis = int(wide.argmax())
            if b - a > leaf and wide[axis]:
                middle = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], middle - a, kind="introselect")]
                left[at] = len(start)
                start += [a, middle]
                stop += [middle, b]
                left += [-1, -1]
            at += 1
        points = points[order]
        low, high, sums = (np.stack([f(points[a:b], 0) for a, b in zip(start, stop, strict=True)]) for f in (np.min, np.max, np.sum))
        return cls(points=points, start=np.array(start), stop=np.array(stop), left=np.array(left), low=low, high=high, sums=sums), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, sums, clusters): totals by centroid, and the centroid of each vector in the tree's order.

        Goes down level by level; the nodes of a level are judged together.
        """
        k = len(centroids)
        counts, sums, clusters = np.zeros(k, np.int64), np.zeros((k, centroids.shape[1]), np.int64), np.empty(len(self.points), np.int64)
        nodes, candidates = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            # Twice the middle against twice the centroid, so that halves stay integers.
            away = _squares(low + high, 2 * centroids)
            away[~candidates] = np.iinfo(np.int64).max
            candidates = candidates & ~_dominated(centroids, away.argmin(1), low, high)
            one = candidates.sum(1) == 1
            for node, cluster in zip(nodes[one].tolist(), candidates[one].argmax(1).tolist(), strict=True):
                a, b = self.start[node], self.stop[node]
                counts[cluster] += b - a
                sums[cluster] += self.sums[node]
                clusters[a:b] = cluster
            leaf = ~one & (self.left[nodes] < 0)
            for node, left in zip(nodes[leaf].tolist(), candidates[leaf], strict=True):
                a, b = self.start[node], self.stop[node]
                open_to = np.flatnonzero(left)
                nearest = open_to[_squares(self.points[a:b], centroids[open_to]).argmin(1)]
                clusters[a:b] = nearest
                counts += np.bincount(nearest, minlength=k)
                np.add.at(sums, nearest, self.points[a:b])
            further = ~one & ~leaf
            nodes = np.repeat(self.left[nodes[further]], 2) + np.tile([0, 1], int(further.sum()))
            candidates = np.repeat(candidates[further], 2, axis=0)
        return counts, sums, clusters

    def to_bytes(self) -> list[bytes]:
        return [getattr(self, name).astype(np.int64).tobytes() for name in self.FIELDS]

    @classmethod
    def from_bytes(cls, fields: list[bytes], dimensions: int) -> KdTree:
        arrays = {name: np.frombuffer(held, np.int64) for name, held in zip(cls.FIELDS, fields, strict=True)}
        return cls(**{name: x if name in ("start", "stop", "left") else x.reshape(-1, dimensions) for name, x in arrays.items()})


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each point."""
    most = max(1, *(int(np.abs(x).max()) for x in (points, centroids) if x.size))
    if 4 * points.shape[1] * most * most < 1 << 53:  # then every number on the way is exact as a double
        p, c = points.astype(float), centroids.astype(float)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


def _dominated(centroids: np.ndarray, nearest: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which centroids are farther than each box's nearest one from all of the box.

    The corner that lies farthest in the direction of a centroid decides: if that is
    strictly nearer to the other one, so is every point.
    """
    out = np.zeros((len(nearest), len(centroids)), bool)
    best = centroids[nearest]
    for c, centroid in enumerate(centroids):
        toward = centroid - best
        corner = np.where(toward > 0, high, low)
        out[:, c] = (toward * (centroid + best - 2 * corner)).sum(1) > 0
    return out


def _integers(embeddings: pa.Array, scale: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their components as integers)."""
    embeddings = embeddings.cast(pa.large_list(pa.float64()))
    sizes = np.diff(embeddings.offsets.to_numpy())
    right = np.flatnonzero((sizes == dimensions) & np.asarray(embeddings.is_valid()))
    values = embeddings.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(values).all(1)  # nulls are NaN by now
    return right[finite], np.clip(np.floor(values[finite] * scale), -_LIMIT, _LIMIT).astype(np.int64)


def _trees(vectors: DataFrame, scale: int, dimensions: int) -> DataFrame:
    """Rows (ids, missing, *fields of a tree): ids in the tree's order; missing: which are null."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def tree() -> pa.RecordBatch:
            ids, missing, points = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            made, order = KdTree.build(points)
            row = [ids[order].tobytes(), missing[order].tobytes(), *made.to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["ids", "missing", *KdTree.FIELDS])

        for batch in batches:
            rows, points = _integers(batch.column(1), scale, dimensions)
            ids = batch.column(0)
            missing = np.asarray(ids.is_null())[rows]
            ids = ids.fill_null(0).to_numpy()[rows]
            for i in range(0, len(rows), BLOCK):
                if held and sum(len(x[0]) for x in held) + len(rows[i : i + BLOCK]) > BLOCK:
                    yield tree()
                held.append((ids[i : i + BLOCK], missing[i : i + BLOCK], points[i : i + BLOCK]))
        if sum(len(x[0]) for x in held):
            yield tree()

    return vectors.mapInArrow(releasing(build), ", ".join(f"{name} binary" for name in ("ids", "missing", *KdTree.FIELDS)))


def _load(row: dict, dimensions: int) -> KdTree:
    return KdTree.from_bytes([row[name] for name in KdTree.FIELDS], dimensions)


def _first_centroids(trees: DataFrame, k: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors of least hash of their ids; a task sends its k least."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, list[int]]] = []
        for batch in batches:
            for row in batch.to_pylist():
                points = np.frombuffer(row["points"], np.int64).reshape(-1, dimensions)
                ids, missing = np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["missing"], bool).tolist()
                hashes = [(hashlib.sha256(f"{seed}:{x}".encode()).hexdigest(), i) for i, (x, gone) in enumerate(zip(ids, missing, strict=True)) if not gone]
                # Vectors of one id, be they many, are told apart by their components.
                edge = max(sorted(h for h, _ in hashes)[:k], default="")
                found = sorted(found + [(h, points[i].tolist()) for h, i in hashes if h <= edge])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["hash", "point"])

    rows = trees.mapInArrow(releasing(least), "hash string, point array<long>").orderBy("hash", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64).reshape(-1, dimensions)


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of the means, empty ones where they were."""
    dimensions = centroids.shape[1]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                more, added, _ = _load(row, dimensions).assign(centroids)
                counts, sums = counts + more, sums + added
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([[counts[i], *sums[i]] for i in held], pa.list_(pa.int64()))], names=["cluster", "totals"])

    rows = trees.mapInArrow(releasing(totals), "cluster int, totals array<long>").select("cluster", F.posexplode("totals").alias("place", "total"))
    added = {(r.cluster, r.place): int(r.total) for r in rows.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := added.get((c, 0), 0):
            out[c] = [added[c, 1 + d] // n for d in range(dimensions)]
    return out


def cluster_vectors(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid) for each vector kept.

    distance is squared, inertias are its sums (null beyond 64 bits), centroid is the
    final one's components.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    trees = materialise(_trees(vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast("array<double>").alias("embedding")), scale, dimensions))
    centroids = _first_centroids(trees, k, seed, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(trees, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _load(row, dimensions)
                _, _, clusters = tree.assign(centroids)
                distance = ((tree.points - centroids[clusters]) ** 2).sum(1)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["missing"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(clusters, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    if not len(centroids):
        trees = trees.where("false")
    found = trees.mapInArrow(releasing(assigned), "vec_id long, cluster int, distance long")
    summed = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part")).collect()
    total, part = sum(int(r.part) for r in summed), {r.cluster: int(r.part) for r in summed}
    long = lambda x: x if x < 1 << 63 else None
    table = spark.createDataFrame([(c, long(part[c]), long(total), centroids[c].tolist()) for c in sorted(part)], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
