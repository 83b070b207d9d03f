"""Order statistics and top shares: exact beside sorting, without a sort in the plan."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators.select import top_flag, top_fraction
from furlong.plans.queries import QUERIES
from furlong.scale import selection
from furlong.scale.quantiles import exact_quantiles

SMALL = "/root/testdata/sf0.001"


def test_a_hundred_and_eleven_columns(spark):
    """The modelling table of the description: gaps, ties, constants and wide ranges, three quantiles each."""
    rng = np.random.default_rng(1)
    n, p = 20_000, 111
    x = rng.standard_normal((n, p)) * 10.0 ** rng.integers(-3, 6, p)
    x[:, ::7] = np.round(x[:, ::7])
    x[:, 5] = 3.0
    x[rng.random((n, p)) < 0.05] = np.nan
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(x.tolist(), cols).repartition(8).cache()
    df.count()
    start = time.monotonic()
    got = exact_quantiles(df, cols, [0.01, 0.5, 0.99])
    took = time.monotonic() - start
    df.unpersist()
    want = np.nanquantile(x, [0.01, 0.5, 0.99], axis=0).T
    assert np.allclose([got[c] for c in cols], want, rtol=1e-12, atol=0)
    assert took < 60


@pytest.mark.parametrize("held", [5, 300, 100_000])
def test_ranks_among_ties_and_extremes(spark, held):
    """Few different values a gap may hold, so that ranks are narrowed, found on cuts and counted."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 40, 3000), rng.standard_normal(3000) * 1e-9, [np.inf, -np.inf, 1e300], np.full(2000, 7.0)])
    df = spark.createDataFrame([(float(a), None if a > 5 else float(-a)) for a in v], "a double, b double")
    ranks = [0, 1, 100, 2999, 3000, 5000, 5999]
    (n, a), (m, b) = selection.order_statistics(df, ["a", "b"], lambda n: [r for r in ranks if r < n], held)
    assert n == len(v) and m == (v <= 5).sum()
    assert a == {r: np.sort(v)[r] for r in ranks}
    assert b == {r: np.sort(-v[v <= 5])[r] for r in ranks if r < m}


def test_columns_beyond_one_pass(spark, monkeypatch):
    monkeypatch.setattr(selection, "AT_ONCE", 2)
    df = spark.range(101).selectExpr(*[f"cast(id * {i} as double) AS c{i}" for i in range(5)])
    assert exact_quantiles(df, df.columns, [0.5]) == {f"c{i}": [50.0 * i] for i in range(5)}
    assert exact_quantiles(df.limit(0), df.columns, [0.5]) == {f"c{i}": [None] for i in range(5)}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25, 0.5, 1.0])
def test_top_share_with_ties_at_the_cut(spark, share):
    rows = [(i, i % 13, None if i % 50 == 0 else float(i % 4) / 3) for i in range(997)]
    df = spark.createDataFrame(rows, "k int, g int, s double").repartition(5)
    ranked = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[1], r[0]))
    want = ranked[: int(np.ceil(round(share * len(ranked), 9)))]
    assert sorted(r["k"] for r in top_fraction(df, "s", ["g", "k"], share).collect()) == sorted(r[0] for r in want)
    flags = {r["k"]: r["top"] for r in top_flag(df, "s", ["g", "k"], share).collect()}
    assert len(flags) == 997 and {k for k, f in flags.items() if f} == {r[0] for r in want}


def test_scores_that_differ_far_behind_the_point_are_no_ties(spark):
    df = spark.range(1000).selectExpr("id AS k", "1e-12 + id * 1e-16 AS s")
    assert sorted(r["k"] for r in top_fraction(df, "s", ["k"], 0.01).collect()) == list(range(990, 1000))


@pytest.mark.parametrize("name", ["lift_top10", "top_fraction", "select_bets"])
def test_no_range_exchange(spark, name):
    text = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text


def test_only_ties_are_ordered(spark, monkeypatch):
    """What goes through the range sort are the rows at the cut."""
    from furlong.operators import select

    seen = []
    real = select.cut_row
    monkeypatch.setattr(select, "cut_row", lambda df, order, k: seen.append(df.count()) or real(df, order, k))
    df = spark.range(1000).withColumn("s", F.floor(F.col("id") / 10).cast("double"))
    assert top_fraction(df, "s", ["id"], 0.015).count() == 15 and seen == [10]
    assert top_fraction(df, "s", ["id"], 0.02).count() == 20 and seen == [10]
