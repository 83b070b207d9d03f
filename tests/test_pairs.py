"""Correlations of pairs over the rows that have both values."""

import numpy as np
import pandas as pd
import pytest

from furlong.operators.preprocess import correlation_pairs


def test_a_hundred_and_eleven_columns_with_gaps(spark):
    rng = np.random.default_rng(4)
    n, p = 5_000, 111
    x = rng.standard_normal((n, p)) + rng.standard_normal((n, 1)) * rng.random(p)
    x = x * 10.0 ** rng.integers(-3, 4, p) + 10.0 ** rng.integers(0, 7, p)
    x[:, 3] = 5.0
    gaps = rng.random((n, p)) < 0.1
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)]).mask(gaps)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"c{i} double" for i in range(p)))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_pairs(df.repartition(6), df.columns).collect()}
    want = frame.corr()
    assert len(got) == p * (p - 1) // 2
    for (a, b), r in got.items():
        if "c3" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-7)


def test_pairs_without_common_rows_have_none(spark):
    df = spark.createDataFrame([(1.0, None, 2), (2.0, None, 1), (None, 1.0, 5)], "a double, b double, c int")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_pairs(df, df.columns).collect()}
    assert got == {("a", "b"): None, ("a", "c"): pytest.approx(-1.0), ("b", "c"): None}
    assert {r["r"] for r in correlation_pairs(df.limit(0), df.columns).collect()} <= {None}
