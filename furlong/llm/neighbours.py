"""Approximate nearest neighbours in a forest of random-projection trees.

Trees split a bounded sample at the median of random projections; every vector
falls to one leaf of each tree. A query holds one priority queue over the nodes
of all trees and opens the most promising until its leaves hold enough vectors.
The vectors of opened leaves are then ranked by exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down

NEAREST = 10
TREES = 8
# Vectors in a leaf, on average, and the bound of the sample that makes the trees.
LEAF = 1024
SAMPLE = 100_000
# A query opens leaves until they hold this share of the vectors and this many;
# it is what recall asks for where vectors have little structure.
SHARE = 0.8
AT_LEAST = 10_000
SEED = 11
_SALTS = 64


@dataclass
class Forest:
    """Nodes of all trees: a projection and a cut, or a leaf."""

    roots: list[int]
    normal: np.ndarray  # node x dimension
    cut: np.ndarray
    child: np.ndarray  # node x 2; -1 for leaves
    filled: np.ndarray  # node: share of the sample in the leaf

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """vector x tree: the leaf each vector falls to."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.child[at, 0] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.cut[node]
                at[inner] = self.child[node, side.astype(int)]
            out[:, t] = at
        return out

    def search(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves of all trees, nearest cuts first, until they hold ``share`` of the sample."""
        queue = [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0.0
        margins = self.normal @ q - self.cut
        while queue and held < share:
            far, node = heapq.heappop(queue)
            if self.child[node, 0] < 0:
                found.append(node)
                held += self.filled[node]
                continue
            m = margins[node]
            near, other = self.child[node, int(m > 0)], self.child[node, int(m <= 0)]
            heapq.heappush(queue, (far, near))
            heapq.heappush(queue, (max(far, abs(m)), other))
        return found


def grow(sample: np.ndarray, trees: int, leaf: float, seed: int) -> Forest:
    """Trees over the rows of ``sample`` down to about ``leaf`` rows; equal rows stay together."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    normal, cut, child, filled, roots = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        me = len(cut)
        normal.append(np.zeros(d))
        cut.append(0.0)
        child.append([-1, -1])
        filled.append(len(rows) / max(1, len(sample)))
        if len(rows) <= max(leaf, 1):
            return me
        for _ in range(8):
            a, b = sample[rng.choice(rows, 2)]
            w = a - b if rng.random() < 0.5 else rng.standard_normal(d)
            size = np.linalg.norm(w)
            if size == 0:
                continue
            w = w / size
            p = sample[rows] @ w
            c = float(np.median(p))
            right = p > c
            if 0 < right.sum() < len(rows):
                normal[me], cut[me] = w, c
                child[me] = [node(rows[~right]), node(rows[right])]
                return me
        return me

    for _ in range(trees):
        roots.append(node(np.arange(len(sample))))
    return Forest(roots, np.array(normal).reshape(-1, d), np.array(cut), np.array(child).reshape(-1, 2), np.array(filled))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, dim, vec, ids) of usable vectors; those equal in a batch become one row."""
    for batch in batches:
        groups: dict[bytes, list[int]] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or None in v:
                continue
            x = np.array(v, np.float64) + 0.0  # -0.0 as 0.0
            if np.isfinite(x).all() and x.any():
                groups.setdefault(x.tobytes(), []).append(i)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([xxhash.xxh3_128_digest(v) for v in groups], pa.binary()),
                pa.array([len(v) // 8 for v in groups], pa.int32()),
                pa.array(list(groups), pa.binary()),
                pa.array([sorted(ids) for ids in groups.values()], pa.list_(pa.int64())),
            ],
            ["key", "dim", "vec", "ids"],
        )


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = NEAREST,
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    share: float = SHARE,
    at_least: int = AT_LEAST,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all
    other rows. Score is the Euclidean distance of the original vectors in
    double precision; ties go to the smaller id. Vectors that are null, empty or
    all zero, or hold a null or a number that is not finite, take no part, nor do
    null ids; nor do vectors of other lengths than the most common one. Equal
    vectors are one point of the forest, which stands for its k + 1 smallest
    ids, all that can be among the nearest k; repeated ids count once. An empty
    table gives an empty result. Other columns are ignored.

    The trees come from at most ``sample`` points, those of the smallest hash;
    all vectors are indexed. A query opens leaves until they hold ``share`` of
    the points and ``at_least``, points met in several trees counting each time.
    """
    spark = vectors.sparkSession
    top = k + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    clean = rows.mapInArrow(_clean, "key binary, dim int, vec binary, ids array<long>")
    clean = lay_down(clean, "vectors")
    dims = clean.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = dims["dim"] if dims else 1
    clean = clean.where(F.col("dim") == dim)

    def smallest(found: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate(found.column("ids").to_numpy()))[:top]
        return pa.table({"key": [found["key"][0].as_py()], "vec": [found["vec"][0].as_py()], "ids": [ids.tolist()]})

    # the smallest ids of a vector, first in salted groups and then together
    few = clean.select("key", "vec", F.slice("ids", 1, top).alias("ids"), F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(_SALTS)).alias("salt"))
    kind = "key binary, vec binary, ids array<long>"
    points = few.groupBy("key", "salt").applyInArrow(smallest, kind).groupBy("key").applyInArrow(smallest, kind)
    points = lay_down(points, "points")
    asked = clean.select("key", F.explode(F.filter("ids", lambda i: F.pmod(i, F.lit(every)) == 0)).alias("query_id")).distinct()
    asked = lay_down(asked, "queries")
    n = points.count()

    picked = points.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toArrow()
    base = _matrix(picked.column("vec").combine_chunks()) if picked.num_rows else np.zeros((0, dim))
    enough = max(share, at_least / max(1, n))
    forest = spark.sparkContext.broadcast(grow(base, trees, leaf * len(base) / max(1, n), seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = forest.value.leaves_of(_matrix(batch.column(1)))
            at = np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            repeated = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves.ravel()), *repeated.columns], ["leaf", "key", "vec", "ids"]
            )

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest.value.search(q, enough) for q in _matrix(batch.column(1))] if batch.num_rows else []
            at = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(f, np.int32) for f in found]) if found else np.empty(0, np.int32)),
                 *batch.take(pa.array(at, pa.int64())).columns],
                ["leaf", "key", "vec"],
            )

    placed = points.mapInArrow(place, "leaf int, key binary, vec binary, ids array<long>")
    searched = points.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vec")
    searched = searched.repartition("key").mapInArrow(open_leaves, "leaf int, key binary, vec binary")

    def rank(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The nearest of one leaf for the queries that opened it."""
        out: dict[str, list] = {"key": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            x = _matrix(right.column("vec").combine_chunks())
            q = _matrix(left.column("vec").combine_chunks())
            ids = right.column("ids").to_pylist()
            squared = (x**2).sum(axis=1) + (q**2).sum(axis=1)[:, None] - 2 * (q @ x.T)
            slack = 1e-9 * (1 + (x**2).sum(axis=1).max() + (q**2).sum(axis=1).max())
            for key, one, rough in zip(left.column("key").to_pylist(), q, squared, strict=True):
                near = np.arange(len(x))
                if len(x) > top:  # exact distances only where rounding leaves a doubt
                    near = np.flatnonzero(rough <= np.partition(rough, top - 1)[top - 1] + slack)
                distance = np.sqrt(((x[near] - one) ** 2).sum(axis=1))
                pairs = sorted((d, j) for d, i in zip(distance.tolist(), near, strict=True) for j in ids[i])[:top]
                out["key"] += [key] * len(pairs)
                out["vec_id"] += [j for _, j in pairs]
                out["score"] += [s for s, _ in pairs]
        return pa.table({"key": pa.array(out["key"], pa.binary()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    near = (
        searched.groupBy("leaf")
        .cogroup(placed.groupBy("leaf"))
        .applyInArrow(rank, "key binary, vec_id long, score double")
        .distinct()
    )
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    best = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")
    answers = asked.join(best, "key").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
