"""Gradient-boosted trees over stored blocks of binned features.

The trees are those of ``GBTClassifier``: its thresholds, row samples, variance gains
and logistic gradients. That learner holds every row as objects, reads them again from
disk once they outgrow the executors' memory, and stores predictions and residuals beside them.
Here a row is a byte a feature, written once; a pass over the blocks works out the
predictions of the trees so far and adds up histograms, one pass for each level of a tree.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.scale import storage

# Rows of a block; a block's columns are read and worked on at once.
BLOCK_ROWS = 1 << 15
# Variance under which Spark's learner ends a branch.
_EPSILON = 2.0**-52
# Random numbers that are made one after another.
_LANE = 32


class Tree(NamedTuple):
    """Nodes in pre-order; a leaf has the feature -1. A row goes left where its bin is at most ``bin``."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    predict: list[float]
    impurity: list[float]
    gain: list[float]
    stats: list[tuple[float, float, float]]


# -- Spark's random numbers ---------------------------------------------------


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words."""
    h = seed
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        h ^= k
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def first_state(seed: int) -> int:
    """State of Spark's generator for a seed."""
    data = struct.pack(">q", seed)
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x = x ^ (x >> np.uint64(35))
    return x ^ (x << np.uint64(4))


def _tables(images: np.ndarray) -> np.ndarray:
    """A linear map of 64 bits as its values for each byte, from its images of the single bits."""
    out = np.zeros((8, 256), np.uint64)
    for bit in range(64):
        has = np.arange(256) >> bit % 8 & 1 == 1
        out[bit // 8, has] ^= images[bit]
    return out


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(8):
        out ^= tables[k][x >> np.uint64(8 * k) & np.uint64(255)]
    return out


@lru_cache(None)
def _jump(level: int) -> np.ndarray:
    """The map of ``_LANE * 2 ** level`` steps."""
    images = np.uint64(1) << np.arange(64, dtype=np.uint64)
    if not level:
        for _ in range(_LANE):
            images = _step(images)
        return _tables(images)
    half = _jump(level - 1)
    return _tables(_mapped(half, _mapped(half, images)))


def uniforms(state: int, n: int) -> tuple[np.ndarray, int]:
    """The next ``n`` doubles of the generator and its state after them.

    Steps are linear maps of the state's bits: runs of ``_LANE`` steps begin where powers of
    the map lead, and are made side by side.
    """
    if not n:
        return np.empty(0), state
    lanes, level = np.array([state], np.uint64), 0
    while len(lanes) * _LANE < 2 * n:
        lanes = np.concatenate([lanes, _mapped(_jump(level), lanes)])
        level += 1
    states = np.empty((len(lanes), _LANE), np.uint64)
    for k in range(_LANE):
        states[:, k] = lanes = _step(lanes)
    states = states.ravel()[: 2 * n]
    high = (states[0::2] & np.uint64((1 << 26) - 1)) << np.uint64(27)
    low = states[1::2] & np.uint64((1 << 27) - 1)
    return (high + low).astype(np.float64) * 2.0**-53, int(states[-1])


# -- thresholds ---------------------------------------------------------------


def thresholds(sample: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Split candidates of a feature from sampled values; zeros are counted as what is left of the sample expected."""
    values, counts = np.unique(sample[sample != 0.0], return_counts=True)
    counts = counts.astype(np.float64)
    kept = float(counts.sum())
    if expected - kept > _EPSILON * kept * 100:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - kept)
    if len(values) < 2:
        return np.empty(0)
    if len(values) - 1 <= most:
        return (values[:-1] + values[1:]) / 2.0
    stride = expected / (most + 1)
    out, current, target = [], counts[0], stride
    for i in range(1, len(values)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def _candidates(rows: DataFrame, n: int, bins: int, seed: int) -> list[np.ndarray]:
    spark = rows.sparkSession
    required = max(bins * bins, 10_000)
    share = required / n if required < n else 1.0
    picked = rows.select("x")
    if share < 1:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sampled = picked._jdf.toJavaRDD().sample(False, share, draw)
        picked = DataFrame(spark._jsparkSession.createDataFrame(sampled, picked._jdf.schema()), spark)
    sample = np.array([r[0] for r in picked.collect()], np.float64)
    width = sample.shape[1] if len(sample) else 0
    return [thresholds(sample[:, k], share * n, min(bins, n) - 1) for k in range(width)]


# -- blocks -------------------------------------------------------------------

_BLOCK = "bins binary, label binary, taken binary"


def _blocks(rows: DataFrame, cuts: list[np.ndarray], rate: float, trees: int, seed: int, path: str) -> DataFrame:
    """Binned rows, a row of the table for each block; with a bit for each tree that takes the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = seed + TaskContext.get().partitionId() + 1
        own = [first_state(first + m) for m in range(trees)] if rate < 1 else []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)]).astype(np.uint8)
                taken = np.zeros(some.num_rows, np.int64)
                for m in range(len(own)):
                    drawn, own[m] = uniforms(own[m], some.num_rows)
                    taken |= (drawn < rate).astype(np.int64) << m
                label = some.column(1).to_numpy(zero_copy_only=False)
                if not np.isin(label, (0.0, 1.0)).all():
                    raise ValueError("boosted trees are for labels 0 and 1")
                label = label.astype(np.int8)
                cells = [[bins.tobytes()], [label.tobytes()], [taken.tobytes() if rate < 1 else b""]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["bins", "label", "taken"])

    rows.mapInArrow(run, _BLOCK).write.parquet(path)
    return rows.sparkSession.read.schema(_BLOCK).parquet(path)


def _at_nodes(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node each row ends in."""

    def below(node: int) -> np.ndarray:
        if tree.feature[node] < 0:
            return np.uint8(node)
        goes_right = bins[tree.feature[node]] > tree.bin[node]
        return np.where(goes_right, below(tree.right[node]), below(tree.left[node]))

    return np.broadcast_to(below(0), bins.shape[1])


def _histograms(blocks: DataFrame, width: int, bins: int, trees: list[Tree], rate: float, step: float,
                grown: Tree, open_nodes: list[int]) -> np.ndarray:
    """(open node, feature, bin, [rows, sum, sum of squares]) of the residuals of ``trees``."""
    place = np.full(len(grown.feature), 255, np.uint8)
    place[open_nodes] = range(len(open_nodes))
    size = len(open_nodes) * bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, width, size))
        leaves = [np.array(t.predict) * (step if m else 1.0) for m, t in enumerate(trees)]
        for batch in batches:
            for cell, labels, taken in zip(*batch.columns, strict=True):
                y = np.frombuffer(labels.as_buffer(), np.int8) * 2.0 - 1.0
                b = np.frombuffer(cell.as_buffer(), np.uint8).reshape(width, -1)
                if trees:
                    predicted = np.zeros(len(y))
                    for tree, leaf in zip(trees, leaves, strict=True):
                        predicted += leaf[_at_nodes(tree, b)]
                    y = 4.0 * y / (1.0 + np.exp(2.0 * y * predicted))
                node = place[_at_nodes(grown, b)]
                use = node != 255
                if rate < 1:
                    use &= (np.frombuffer(taken.as_buffer(), np.int64) >> len(trees) & 1).astype(bool)
                if not use.all():
                    node, y, b = node[use], y[use], b[:, use]
                squares, base = y * y, node.astype(np.int64) * bins
                for k in range(width):
                    key = base + b[k]
                    total[0, k] += np.bincount(key, minlength=size)
                    total[1, k] += np.bincount(key, y, size)
                    total[2, k] += np.bincount(key, squares, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "h"]
        )

    found = np.zeros((3, width, size))
    for row in sorted(blocks.mapInArrow(run, "part int, h binary").collect()):
        found += np.frombuffer(row["h"]).reshape(found.shape)
    return found.reshape(3, width, len(open_nodes), bins).transpose(2, 1, 3, 0)


# -- growing ------------------------------------------------------------------


def _variance(n, total, squares):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def _best(h: np.ndarray, splits: list[int], parent: float | None):
    """(feature, bin, gain, impurity, stats, left stats, right stats) of a node; feature -1 without a split."""
    stats = h[0].sum(axis=0)
    impurity = float(_variance(*stats)) if parent is None else parent
    best = (-1, 0, -np.inf, impurity, stats, None, None)
    for k, count in enumerate(splits):
        if not count:
            continue
        upto = np.cumsum(h[k], axis=0)
        left, right = upto[:count], upto[-1] - upto[:count]
        n = left[:, 0] + right[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = impurity - left[:, 0] / n * _variance(*left.T) - right[:, 0] / n * _variance(*right.T)
        gain = np.where((left[:, 0] < 1) | (right[:, 0] < 1) | (gain < 0), -np.inf, gain)
        at = int(np.argmax(gain))
        if gain[at] > best[2]:
            best = (k, at, float(gain[at]), impurity, stats, left[at], right[at])
    return best


def _pruned(t: Tree, tree: Tree, node: int) -> int:
    """Copies the branch at ``node`` into ``t`` in pre-order; leaves that predict the same become one."""
    here = len(t.feature)
    for mine, its in zip(t, tree, strict=True):
        mine.append(its[node])
    if tree.feature[node] >= 0:
        t.left[here] = _pruned(t, tree, tree.left[node])
        t.right[here] = _pruned(t, tree, tree.right[node])
        a, b = t.left[here], t.right[here]
        if t.feature[a] < 0 and t.feature[b] < 0 and t.predict[a] == t.predict[b]:
            for mine in t:
                del mine[here + 1 :]
            t.feature[here], t.left[here], t.right[here], t.gain[here] = -1, -1, -1, -1.0
            t.predict[here] = tree.predict[tree.left[node]]
    return here


def _grow(histograms, splits: list[int], depth: int) -> Tree:
    tree = Tree([], [], [], [], [], [], [], [])

    def add(stats, impurity: float) -> int:
        n, total, _ = stats
        for column, value in zip(tree, (-1, 0, -1, -1, total / n if n else 0.0, impurity, -1.0, tuple(stats)), strict=True):
            column.append(value)
        return len(tree.feature) - 1

    add((0.0, 0.0, 0.0), 0.0)
    open_nodes = [0]
    for level in range(depth):
        if not open_nodes:
            break
        coming = []
        for node, h in zip(open_nodes, histograms(tree, open_nodes), strict=True):
            k, at, gain, impurity, stats, left, right = _best(h, splits, tree.impurity[node] if level else None)
            if not level:
                tree.stats[0], tree.impurity[0] = tuple(stats), impurity
                tree.predict[0] = stats[1] / stats[0] if stats[0] else 0.0
            if k < 0 or gain <= 0:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = k, at, gain
            for side, part in ((tree.left, left), (tree.right, right)):
                variance = float(_variance(*part))
                side[node] = add(part, variance)
                if abs(variance) >= _EPSILON:
                    coming.append(side[node])
        open_nodes = coming
    out = Tree([], [], [], [], [], [], [], [])
    _pruned(out, tree, 0)
    return out


# -- the learner --------------------------------------------------------------


def _load(learner: GBTClassifier, spark: SparkSession, trees: list[Tree], cuts: list[np.ndarray]) -> GBTClassificationModel:
    """Spark's model of the trees, by way of its file format."""
    value = lambda params: {p.name: v for p, v in params.items()}
    about = {
        "class": "org.apache.spark.ml.classification.GBTClassificationModel", "timestamp": 0, "sparkVersion": spark.version,
        "uid": learner.uid, "paramMap": value(learner._paramMap), "defaultParamMap": value(learner._defaultParamMap),
        "numFeatures": len(cuts), "numTrees": len(trees),
    }
    tree = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": {}, "defaultParamMap": {}}
    step = learner.getStepSize()
    nodes, weights = [], []
    for m, t in enumerate(trees):
        weights.append((m, json.dumps(tree | {"uid": f"{learner.uid}_{m}"}), step if m else 1.0))
        for i, k in enumerate(t.feature):
            split = (k, [float(cuts[k][t.bin[i]])], -1) if k >= 0 else (-1, [], -1)
            stats = [float(x) for x in t.stats[i]]
            nodes.append((m, (i, float(t.predict[i]), t.impurity[i], stats, int(stats[0]), t.gain[i], t.left[i], t.right[i], split)))
    path = storage.new_path(spark, "boosted")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(nodes, _NODES).coalesce(1).write.parquet(f"{path}/data")
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = GBTClassificationModel.load(path)
    storage.drop(spark, [path])
    return model


_NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, "
    "split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
_OWN = {"featuresCol", "labelCol", "maxIter", "maxDepth", "maxBins", "stepSize", "subsamplingRate", "seed"}


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` that trains on stored blocks; settings it does not know go to Spark's own learner."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        depth, most, rate, rounds = self.getMaxDepth(), self.getMaxBins(), self.getSubsamplingRate(), self.getMaxIter()
        if {p.name for p in self._paramMap} - _OWN or depth > 6 or most > 128 or (rate < 1 and rounds > 63):
            return super()._fit(dataset)
        spark, seed, step = dataset.sparkSession, self.getSeed(), self.getStepSize()
        rows = dataset.select(
            vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")
        )
        n = rows.count()
        cuts = _candidates(rows, n, most, seed)
        path = storage.new_path(spark, "boosting")
        blocks = _blocks(rows, cuts, rate, rounds, seed, path)
        bins = max(map(len, cuts)) + 1  # a larger sample than expected has more thresholds than asked for
        trees: list[Tree] = []
        for _ in range(rounds):
            grow = lambda grown, nodes: _histograms(blocks, len(cuts), bins, trees, rate, step, grown, nodes)
            trees.append(_grow(grow, [len(c) for c in cuts], depth))
        storage.drop(spark, [path])
        return _load(self, spark, trees, cuts)
