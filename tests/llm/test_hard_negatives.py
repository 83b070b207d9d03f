"""Hard negatives beside brute force; the curve and the bounds by their properties."""

import math

import numpy as np
import pytest

from llm_support import SMALL
from furlong.llm import hard_negatives as hn
from furlong.llm.queries import QUERIES


def mined_by_force(rows, every=100, k=5):
    """Sorted result rows of (id, label, vector) rows."""
    usable = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(256 * float(x)) for x in v))
        if row not in usable:
            usable.append(row)
    out = []
    for i, label, v in usable:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in usable if len(w) == len(v)]
        positives = sorted((s, j) for s, j, other in scored if other == label and j != i)[:k]
        for ps, p in positives:
            near = sorted((s, j) for s, j, other in scored if other != label and 80 * -ps <= 100 * -s <= 100 * -ps)
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table]
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, SMALL).collect())
    assert len(got) > 10 and got == mined_by_force(rows)


def clustered(n=3000, dim=6):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((12, dim)) * 4
    of = rng.integers(0, 12, n)
    return [(i, int(of[i] % 4), (centre[of[i]] + rng.standard_normal(dim) * 0.2).tolist()) for i in range(n)]


def test_zone_maps_leave_most_blocks_unread(spark):
    rows = clustered()
    read = {}
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hn.hard_negatives(df, block=32, report=lambda phase, pairs: read.update({phase: pairs}))
    assert sorted(tuple(r) for r in got.collect()) == mined_by_force(rows)
    # 30 anchors times at least 3000 / 32 blocks
    assert 0 < read["negative-found"] < 0.4 * 30 * 94 and 0 < read["negative-positives"] < 0.25 * 30 * 94


def test_odd_rows_ties_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELL_ANCHORS", 1)
    monkeypatch.setattr(hn, "CELL_ZONES", 2)
    monkeypatch.setattr(hn, "CELL_NUMBERS", 8)
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.5]
    rows = [(i, i % 2, one) for i in range(0, 30)] + [(100 + i, 1, [1.0, 0.5 - i / 100]) for i in range(12)]
    rows += [(200, 0, one), (200, 0, one), (200, 1, one), (300, 2, one), (400, 0, [0.0, 0.0]), (500, 0, [-1.0, 0.1])]
    rows += [(600, None, one), (None, 0, one), (700, 0, None), (800, 0, [nan, 1.0]), (900, 1, [inf, 1.0]), (40, 1, [None, 1.0])]
    rows += [(1000, 0, [1.0, 2.0, 3.0]), (1001, 0, [1.0, 2.0, 2.9]), (1002, 5, [1.0, 2.0, 2.8]), (1100, 0, []), (1101, 0, [])]
    rows += [(1200, 3, [90000.0, 1.0]), (1201, 3, [90000.0, 1.0]), (1202, 4, [80000.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, label int, embedding array<double>, block int, id string, dim int")
    got = sorted(tuple(r) for r in hn.hard_negatives(df, block=4).collect())
    assert got == mined_by_force(rows) and {r[0] for r in got} >= {0, 100, 200, 1000, 1200}
    assert hn.hard_negatives(df.limit(0)).count() == 0


def test_components_out_of_range_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        hn.hard_negatives(df).count()


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (5, 1)])
def test_the_curve_goes_from_neighbour_to_neighbour(dims, bits):
    cells = np.stack(np.meshgrid(*[range(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    keys = hn.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    along = cells[sorted(range(len(cells)), key=keys.__getitem__)].astype(int)
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    rng = np.random.default_rng(3)
    x, a = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (9, 7))
    least, largest = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (largest[:, 0] >= scores.max(axis=1)).all()
    corners = np.where(a > 0, x.max(axis=0), x.min(axis=0))
    assert (largest[:, 0] == (a * corners).sum(axis=1)).all()
    top = np.arange(1, 5000)
    assert all(80 * t <= 100 * f and not 80 * t <= 100 * (f - 1) for t, f in zip(top.tolist(), hn.floor_of(top).tolist()))
