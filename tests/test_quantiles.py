import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furlong.scale.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


def numbers(spark, kind, n=20_000):
    expr = {
        "uniform": F.rand(1) * 1000,
        "heavy_tie": F.when(F.rand(2) < 0.4, F.lit(5.0)).otherwise(F.rand(3) * 10),
        "tail": F.exp(F.randn(4) * 4),
        "negative": -F.rand(5),
        "integers": F.floor(F.rand(6) * 3).cast("double"),
    }[kind]
    return spark.range(n).select(expr.alias("v"))


@pytest.mark.parametrize("kind", ["uniform", "heavy_tie", "tail", "negative", "integers"])
@pytest.mark.parametrize("held", [200_000, 50])
def test_equals_the_sorted_definition(spark, kind, held):
    df = numbers(spark, kind)
    values = [r["v"] for r in df.collect()]
    got = exact_quantiles(df, ["v"], PROBS, held=held)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


def test_nulls_are_left_out_and_empty_columns_give_none(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40),
    st.lists(st.floats(0, 1), min_size=1, max_size=3),
)
def test_small_lists(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], probs, held=3)["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-9, abs=1e-9)
