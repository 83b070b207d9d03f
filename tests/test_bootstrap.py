import hashlib
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furlong.operators import bootstrap


def weight(race, b):
    """Poisson(1) by inversion of a 32-bit draw."""
    digest = hashlib.md5(f"{race}:{b // 4}".encode()).hexdigest()
    u = int(digest[8 * (b % 4) : 8 * (b % 4) + 8], 16) / 2**32
    k, mass = 0, math.exp(-1)
    cum = mass
    while u >= cum and k < 20:
        k += 1
        mass /= k
        cum += mass
    return k


def units(spark, n=300):
    return spark.range(n).select(
        F.col("id").alias("race_id"), (F.col("id") % 5).cast("double").alias("x"), F.lit(1.0).alias("one")
    )


def test_replicates_equal_the_definition(spark):
    got = {r["replicate"]: r for r in bootstrap.replicates(units(spark), ["x", "one"], count=10).collect()}
    assert sorted(got) == list(range(10))
    for b, row in got.items():
        assert row["one"] == sum(weight(i, b) for i in range(300))
        assert row["x"] == sum(weight(i, b) * (i % 5) for i in range(300))


def summed(units, values, count):
    batch = pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(values, pa.float64())], ["unit", "x"])
    (out,) = bootstrap._weighted_sums(["x"], count)(iter([batch]))
    return out.column("x").to_pylist()


@pytest.mark.parametrize("count", [1, 41, 405])
def test_units_of_any_length_draw_by_the_definition(count):
    units = ["", "0", "x" * 200, "\u00e9\u20ac" * 9, *("a" * n for n in range(48, 60)), *map(str, range(95, 120))]
    for u in units:
        assert summed([u], [1.0], count) == [weight(u, b) for b in range(count)]
    together = [sum(weight(u, b) * i for i, u in enumerate(units)) for b in range(count)]
    assert summed(units, range(len(units)), count) == together


def test_digests_are_not_made_one_by_one():
    units = [str(x) for x in range(100_000, 106_000)]

    def one_by_one():
        for u in units:
            for x in range(250):
                hashlib.md5(f"{u}:{x}".encode()).digest()

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    summed(units[:10], np.ones(10), 1000)
    assert seconds(lambda: summed(units, np.ones(len(units)), 1000)) < 0.7 * seconds(one_by_one)


def test_layout_does_not_matter(spark):
    a = bootstrap.replicates(units(spark).repartition(7), ["x"], count=9)
    b = bootstrap.replicates(units(spark).coalesce(1), ["x"], count=9)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 9


def test_weights_have_mean_and_variance_one():
    ws = [weight(i, b) for i in range(500) for b in range(20)]
    mean = sum(ws) / len(ws)
    assert mean == pytest.approx(1, abs=0.04)
    assert sum((w - mean) ** 2 for w in ws) / len(ws) == pytest.approx(1, abs=0.06)


def test_limits_are_the_poisson_distribution():
    limits = [int(x, 16) / 2**32 for x in bootstrap.poisson_limits()]
    assert limits == sorted(limits)
    assert limits[:3] == pytest.approx([math.exp(-1), 2 * math.exp(-1), 2.5 * math.exp(-1)], abs=1e-9)


def test_interval_holds_the_value_and_narrows(spark):
    gains = units(spark, 4000).withColumnRenamed("x", "gain")
    wide = bootstrap.gain_ci(gains.where("race_id < 200"), count=200).first()
    slim = bootstrap.gain_ci(gains, count=200).first()
    for r in (wide, slim):
        assert r["lo"] < r["value"] < r["hi"]
    assert slim["hi"] - slim["lo"] < wide["hi"] - wide["lo"]


def test_roi_replicates_centre_on_the_roi(spark):
    bets = spark.range(3000).select(
        (F.col("id") / 2).cast("bigint").alias("race_id"),
        F.lit(12.0).alias("odds"), (F.col("id") % 10 == 0).cast("int").alias("win"),
    )
    out = bootstrap.prob_profit(bets, count=400).first()
    assert out["replicates"] == 400
    assert out["mean_roi"] == pytest.approx(0.2, abs=0.02)
    assert 0.9 < out["profitable"] <= 1
    lost = bootstrap.prob_profit(bets.withColumn("win", F.lit(0)), count=40).first()
    assert lost["profitable"] == 0


def test_no_bets_give_no_share(spark):
    bets = spark.createDataFrame([], "race_id int, odds double, win int")
    assert bootstrap.prob_profit(bets, count=8).first()["profitable"] is None


def test_paired_losses_skip_excluded_races(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "race_id int, loss double")
    b = spark.createDataFrame([(1, 1.5), (2, 1.0), (3, 1.25)], "race_id int, loss double")
    out = bootstrap.paired_gain(bootstrap.paired_losses(a, b)).first()
    assert (out["gain"], out["races"]) == (pytest.approx(0.125), 2)
