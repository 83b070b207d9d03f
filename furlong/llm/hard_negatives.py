"""Hard negatives from blocks in Hilbert order with zone maps.

Vectors are laid along a Hilbert curve, label by label, and stored in Parquet as
blocks with the least and the largest value of every dimension. Interval arithmetic
on those bounds every inner product of an anchor with a block's rows, and so tells
which blocks an anchor must read: for its positives those of its label that may reach
the score its own block gives already, for its windows those of other labels that may
hold a score inside one. Only those are read; all scores are exact whole numbers.

Anchors meet zone maps and blocks in cells of bounded size, groups of anchors times
groups of blocks. A cell hands on only its own first rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down

EVERY = 100
FIRST = 5
SCALE = 256
# Rows of a block, and bits of the curve in each dimension.
BLOCK = 128
CURVE_BITS = 2
# A cell meets about so many anchors with so many zone maps or so many numbers of blocks.
CELL_ANCHORS = 1 << 13
CELL_ZONES = 1 << 9
CELL_NUMBERS = 1 << 19
_HELD = 1 << 21  # scores or bounds held at once
_NONE = -(1 << 62)


# -- vectors and their place on the curve ----------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Sort keys along the Hilbert curve of rows of grid coordinates below ``2 ** bits``."""
    x = cells.astype(np.uint8).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work from the top bit down
        p = np.uint8(q - 1)
        for i in range(d):
            set_ = (x[:, i] & q) > 0
            t = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & p).astype(np.uint8)
            x[:, 0] ^= np.where(set_, p, t).astype(np.uint8)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.uint8)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, -1] & q) > 0, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= t[:, None]
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1), axis=1)
    return [row.tobytes() for row in packed]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold them."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _matrix(raw: list[bytes], rows: list[int], dim: int) -> np.ndarray:
    """The rows of narrow matrices, one below the other."""
    if not dim:
        return np.zeros((sum(rows), 0), np.int64)
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    parts = [np.frombuffer(b, kinds[len(b) // (n * dim)]).reshape(n, dim) for b, n in zip(raw, rows, strict=True)]
    return np.concatenate(parts).astype(np.int64)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, dim, vec) of the rows that take part, components as whole numbers."""
    for batch in batches:
        ids, labels, dims, vecs = [], [], [], []
        for i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if v is None or None in v:
                continue
            x = np.floor(SCALE * np.array(v, np.float64))
            if not np.isfinite(x).all():
                if np.isfinite(np.array(v, np.float64)).all():
                    raise ValueError("vector components too large for whole inner products")
                continue
            if float(np.abs(x).max(initial=0)) ** 2 * len(x) >= 2.0**62:
                raise ValueError("vector components too large for whole inner products")
            ids.append(i)
            labels.append(label)
            dims.append(len(x))
            vecs.append(_narrow(x.astype(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
            ["id", "label", "dim", "vec"],
        )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, at, n, total, squares) by component of a task's batches."""
    for batch in batches:
        dims, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for dim in np.unique(dims).tolist():
            mine = [v for v, d in zip(vecs, dims, strict=True) if d == dim]
            x = _matrix(mine, [1] * len(mine), dim).astype(float)
            yield pa.RecordBatch.from_pydict(
                {"dim": np.full(dim, dim, np.int32), "at": np.arange(dim, dtype=np.int32),
                 "n": np.full(dim, len(x), np.int64), "total": x.sum(axis=0), "squares": (x**2).sum(axis=0)}
            )


def _along(moments: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Task code: rows with their key on the curve, the dimensions of most variance first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 1 << (CURVE_BITS - 1)
        for batch in batches:
            dims, vecs = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            keys: list[bytes] = [b""] * batch.num_rows
            for dim in set(dims.tolist()) - {0}:
                at = np.flatnonzero(dims == dim)
                mean, spread = moments[dim]
                z = (_matrix([vecs[i] for i in at], [1] * len(at), dim) - mean) / np.maximum(spread, 1e-9)
                cells = np.clip(np.floor(z * half / 1.5) + half, 0, 2 * half - 1)
                cells = cells[:, np.argsort(-spread, kind="stable")]
                for i, key in zip(at, hilbert_keys(cells, CURVE_BITS), strict=True):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "key"])

    return run


_PACKED = pa.schema(
    [("block", pa.int64()), ("label", pa.int64()), ("rows", pa.int32()), ("dim", pa.int32())]
    + [(c, pa.binary()) for c in ("lo", "hi", "ids", "vecs")]
)


def _pack(most: int):
    """Task code: consecutive rows of one label and length as blocks of at most ``most``; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        last, made = None, 0

        def block() -> pa.RecordBatch:
            x = _matrix([r[3] for r in held], [1] * len(held), held[0][2])
            out = {
                "block": first + made, "label": held[0][1], "rows": len(held), "dim": held[0][2],
                "lo": _narrow(x.min(axis=0)), "hi": _narrow(x.max(axis=0)),
                "ids": np.array([r[0] for r in held], np.int64).tobytes(), "vecs": _narrow(x),
            }
            held.clear()
            return pa.RecordBatch.from_pylist([out], schema=_PACKED)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if row == last:
                    continue
                if held and (len(held) == most or row[1:3] != last[1:3]):
                    made += 1
                    yield block()
                held.append(row)
                last = row
        if held:
            made += 1
            yield block()

    return run


def blocks_of(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Stored blocks (block, label, rows, dim, lo, hi, ids, vecs) of (id, label, dim, vec) rows."""
    rows = lay_down(rows, "negative-vectors")
    sums = rows.select("dim", "vec").mapInArrow(_sums, "dim int, at int, n long, total double, squares double")
    sums = sums.groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    moments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in sums.collect():
        mean, spread = moments.setdefault(r["dim"], (np.zeros(r["dim"]), np.zeros(r["dim"])))
        mean[r["at"]] = r["total"] / r["n"]
        spread[r["at"]] = max(0.0, r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2) ** 0.5
    keyed = rows.mapInArrow(_along(moments), "id long, label long, dim int, vec binary, key binary")
    # the id behind the curve, so that a vector that many rows share is dealt over partitions
    laid = keyed.repartitionByRange("dim", "label", "key", "id").sortWithinPartitions("dim", "label", "key", "id", "vec")
    packed = "block long, label long, rows int, dim int, lo binary, hi binary, ids binary, vecs binary"
    return lay_down(laid.mapInArrow(_pack(most), packed), "negative-blocks")


# -- bounds and scores -----------------------------------------------------


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products; in doubles where those are exact, which is faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) inner product of each anchor with any row inside each zone.

    A component times an interval ends at the interval's ends, which one is told by
    the component's sign.
    """
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


def floor_of(top: np.ndarray) -> np.ndarray:
    """The least whole score of at least 80% of ``top``."""
    return top - top // 5


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties by smaller id."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _anchors(every: int, k: int):
    """Task code: the anchors of blocks, with the score of the k-th other row of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("block", "id", "label", "dim", "vec", "floor")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                x = _matrix([r["vecs"]], [r["rows"]], r["dim"])
                for i, scores in zip(at, _product(x[at], x), strict=True):
                    others = scores[ids != ids[i]]
                    floor = int(np.sort(others)[-k]) if len(others) >= k else _NONE
                    out.append({"block": r["block"], "id": int(ids[i]), "label": r["label"], "dim": r["dim"],
                                "vec": _narrow(x[i]), "floor": floor})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return run


class _Group:
    """The anchors of one group, in the order of their numbers, with what they look for."""

    def __init__(self, asked: pa.Table):
        asked = asked.sort_by("anchor")
        self.anchor, self.id, self.label = (asked.column(c).to_numpy() for c in ("anchor", "id", "label"))
        self.vec = _matrix(asked.column("vec").to_pylist(), [1] * asked.num_rows, asked.column("dim")[0].as_py())
        tops = asked.column("tops").to_pylist()
        self.tops = np.full((len(tops), max(map(len, tops), default=0)), _NONE, np.int64)
        for i, t in enumerate(tops):
            self.tops[i, : len(t)] = t
        self.floor = asked.column("floor").to_numpy()


def _choose(negative: bool):
    """Cell code: (block, dim, group, cell, mask) of the blocks that some anchor must read, and which anchors."""

    def run(zone: pa.Table, asked: pa.Table) -> pa.Table:
        block: list[int] = []
        masks: list[bytes] = []
        pairs: list[int] = []
        if asked.num_rows and zone.num_rows:
            a, dim = _Group(asked), zone.column("dim")[0].as_py()
            lo, hi = (_matrix(zone.column(c).to_pylist(), [1] * zone.num_rows, dim) for c in ("lo", "hi"))
            label, names = zone.column("label").to_numpy(), zone.column("block").to_numpy()
            step = max(1, _HELD // len(a.id))
            for s in range(0, len(label), step):
                least, largest = bounds(a.vec, lo[s : s + step], hi[s : s + step])
                same = a.label[:, None] == label[s : s + step]
                if negative:
                    wanted = np.zeros(same.shape, bool)
                    for top in a.tops.T[..., None]:
                        wanted |= (top >= 0) & (largest >= floor_of(top)) & (least <= top)
                    wanted &= ~same
                else:
                    wanted = same & (largest >= a.floor[:, None])
                some = np.flatnonzero(wanted.any(axis=0))
                block += names[s + some].tolist()
                masks += [np.packbits(wanted[:, j]).tobytes() for j in some]
                pairs += wanted[:, some].sum(axis=0).tolist()
        group = asked.column("group")[0].as_py() if block else 0
        return pa.table(
            {"block": pa.array(block, pa.int64()), "group": pa.array([group] * len(block), pa.int32()),
             "mask": pa.array(masks, pa.binary()), "pairs": pa.array(pairs, pa.int64())}
        )

    return run


def _read(negative: bool, k: int):
    """Cell code: exact scores of anchors with the blocks they must read; the first ``k`` of each search."""

    def run(zone: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {n: [np.empty(0, np.int64)] for n in ("anchor", "place", "id", "score")}
        if asked.num_rows and zone.num_rows:
            a, rows = _Group(asked), zone.column("rows").to_pylist()
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in zone.column("ids").to_pylist()])
            x = _matrix(zone.column("vecs").to_pylist(), rows, zone.column("dim")[0].as_py())
            masks = np.stack([np.unpackbits(np.frombuffer(m, np.uint8)) for m in zone.column("mask").to_pylist()])
            of = np.repeat(np.arange(len(rows)), rows)
            step = max(1, _HELD // len(ids))
            for s in range(0, len(a.id), step):
                for i, scores in enumerate(_product(a.vec[s : s + step], x), s):
                    read = masks[of, i] > 0
                    if negative:
                        looks = [(w, read & (scores <= t) & (scores >= floor_of(t))) for w, t in enumerate(a.tops[i]) if t >= 0]
                    else:
                        looks = [(0, read & (ids != a.id[i]))]
                    for place, fits in looks:
                        at = np.flatnonzero(fits)
                        at = at[_best(scores[at], ids[at], k)]
                        out["anchor"].append(np.full(len(at), a.anchor[i]))
                        out["place"].append(np.full(len(at), place))
                        out["id"].append(ids[at])
                        out["score"].append(scores[at])
        return pa.table({n: np.concatenate(v) for n, v in out.items()})

    return run


# -- the search ------------------------------------------------------------


class _Search:
    """Anchors against zone maps, and against the blocks those leave."""

    def __init__(self, stored: DataFrame, groups: int, k: int, report: Callable[[str, int], None] | None):
        self.stored, self.groups, self.k, self.report = stored, groups, k, report
        n = stored.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("rows") * F.col("dim")), F.lit(0))).first()
        self.zone_cells, self.read_cells = -(-n[0] // CELL_ZONES), -(-n[1] // CELL_NUMBERS)

    def _meet(self, rows: DataFrame, anchors: DataFrame, cells: int, work: Callable, kind: str) -> DataFrame:
        """``work`` in each cell: block rows of an anchor group, and a copy of the group's anchors."""
        cells = max(1, cells)
        rows = rows.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
        copies = anchors.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        keys = ["dim", "group", "cell"]
        return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(lambda a, b: work(a, b), kind)

    def first(self, anchors: DataFrame, negative: bool, tag: str) -> DataFrame:
        """(anchor, place, id, score, rank): the first rows of each anchor's searches, stored."""
        zones = self.stored.select(
            "block", "dim", "label", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("group")
        )
        wanted = self._meet(
            zones, anchors, self.zone_cells, _choose(negative), "block long, group int, mask binary, pairs long"
        )
        wanted = lay_down(wanted, f"{tag}-blocks")
        if self.report is not None:
            self.report(tag, wanted.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
        contents = wanted.join(self.stored.select("block", "rows", "dim", "ids", "vecs"), "block")
        found = self._meet(
            contents, anchors, self.read_cells, _read(negative, self.k), "anchor long, place long, id long, score long"
        )
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order))
        return lay_down(ranked.where(F.col("rank") <= self.k), tag)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = EVERY,
    k: int = FIRST,
    block: int = BLOCK,
    report: Callable[[str, int], None] | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. Components x count as
    floor(256 * x), scores are whole inner products. An anchor's positives are the
    first ``k`` other rows of its label, higher scores first, ties by smaller id. For
    each positive the first ``k`` rows of other labels are given whose score is at most
    the positive's and at least 80% of it.

    Rows with a null id, label or vector, or a component that is null or not finite,
    take no part. Rows alike in id, label and vector are one row; others that share an
    id are rows of their own, but not each other's positives. Vectors of different
    lengths never meet. An empty table gives an empty result; other columns are ignored.
    Components whose inner products might leave 64 bits are refused.

    ``report(phase, pairs)`` is told how many (anchor, block) pairs had to be read.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        F.col(f"`{vector_col}`").alias("v"),
    ).dropna("any", subset=["id", "label"])
    stored = blocks_of(rows.mapInArrow(_usable, "id long, label long, dim int, vec binary"), block)
    few = stored.select("block", "label", "rows", "dim", "ids", "vecs").mapInArrow(
        _anchors(every, k), "block long, id long, label long, dim int, vec binary, floor long"
    )
    few = lay_down(few.withColumn("anchor", F.monotonically_increasing_id()), "negative-anchors")
    groups = max(1, -(-few.count() // CELL_ANCHORS))
    none = F.array().cast("array<long>")
    few = few.withColumns(
        {"group": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "tops": none}
    ).drop("block")
    search = _Search(stored, groups, k, report)
    positives = search.first(few, False, "negative-positives")
    tops = positives.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("tops")
    )
    looking = few.drop("tops").join(tops, "anchor")
    negatives = search.first(looking, True, "negative-found")
    pairs = positives.select(
        "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        negatives.join(pairs, ["anchor", "place"])
        .join(few.select("anchor", F.col("id").alias("anchor_id")), "anchor")
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
    )
