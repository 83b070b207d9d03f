"""Plans for hot keys give the rows the ordinary plans give."""

import os

import pytest
from pyspark.sql import Window
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import oracle_check
from furlong.operators import history, race
from furlong.plans.oracle import ORACLE
from furlong.plans.queries import QUERIES
from furlong.scale import skew
from furlong.scale.ordering import with_group_rank, with_position


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def lopsided(spark):
    """9,000 rows: a third on key 7, a sixth on null, the rest spread."""
    k = (
        F.when(F.col("id") % 3 == 0, F.lit(7))
        .when(F.col("id") % 6 == 1, F.lit(None))
        .otherwise(F.col("id") % 2000 + 100)
    )
    return spark.range(9000).select(
        k.cast("bigint").alias("k"), "id", ((F.col("id") * 7919) % 101).cast("double").alias("x")
    )


def test_only_large_shares_are_hot(spark, lopsided, all_hot):
    hot = skew.hot_keys(lopsided, "k")
    found = lopsided.where(skew.is_hot(["k"], hot)).select("k").distinct().collect()
    assert {r["k"] for r in found} == {7, None}


def test_empty_table_has_no_hot_keys(lopsided, all_hot):
    assert skew.hot_keys(lopsided.where("id < 0"), "k") == ()


def test_the_sketch_finds_every_key_above_the_share(spark, all_hot):
    n = 400_000
    df = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 1000 < 10, F.col("id") % 10).otherwise(F.col("id") + 100).alias("k")
    )
    hot = skew.hot_keys(df, "k")
    found = {r["k"] for r in df.where(skew.is_hot(["k"], hot)).select("k").distinct().collect()}
    assert found == set(range(10))


def test_small_tables_have_no_hot_keys(lopsided):
    assert skew.hot_keys(lopsided, "k") == ()


def test_group_totals(lopsided, all_hot):
    totals = {"s": F.sum("x"), "n": F.count(F.lit(1)), "m": F.min(F.struct("x", "id"))}
    hot = skew.with_group_totals(lopsided, "k", totals)
    cold = skew.with_group_totals(lopsided, "k", totals, hot=())
    assert rows(hot) == rows(cold)


def test_group_rank(lopsided, all_hot):
    order = [F.col("x").desc(), F.col("id").asc()]
    assert rows(with_group_rank(lopsided, "k", order, "r")) == rows(
        with_group_rank(lopsided, "k", order, "r", hot=())
    )


def test_positions_are_the_sorted_order(lopsided):
    placed = with_position(lopsided, [F.col("x").desc(), F.col("id").asc()], "pos")
    got = [r["id"] for r in placed.orderBy("pos").collect()]
    want = [r["id"] for r in lopsided.orderBy(F.col("x").desc(), F.col("id").asc()).collect()]
    assert got == want
    assert placed.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (0, 8999, 9000)


def test_lookup_join(spark, lopsided, all_hot):
    names = spark.range(2200).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    for how in ("left", "inner"):
        assert rows(skew.join_lookup(lopsided, names, "k", how)) == rows(
            lopsided.join(names, ["k"], how)
        )


def test_lookup_join_refuses_a_repeated_key(spark, lopsided, all_hot):
    twice = spark.range(5000).select(F.lit(7).cast("bigint").alias("k"), F.col("id").alias("name"))
    with pytest.raises((PySparkException, Py4JJavaError), match="repeats"):
        skew.join_lookup(lopsided, twice, "k").collect()


def test_softmax_and_normalisation(lopsided, all_hot):
    df = lopsided.withColumns({"race_id": F.col("k"), "s": F.col("x") / 50})
    for fn in (race.race_softmax, race.race_normalize):
        hot, cold = fn(df, "s"), fn(df, "s", hot=())
        key = ["id"]
        a = {r["id"]: r["p"] for r in hot.select(*key, "p").collect()}
        b = {r["id"]: r["p"] for r in cold.select(*key, "p").collect()}
        assert a.keys() == b.keys()
        assert all(a[i] == b[i] or a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


@pytest.mark.parametrize("span", [1, 50, 777, 100_000])
def test_rolling_sum_equals_the_sliding_frame(lopsided, span):
    df = lopsided.withColumn("us", (F.col("id") * 37) % 20_000 - 5_000)
    df = df.withColumn("ts", F.timestamp_micros("us"))
    frame = Window.partitionBy("k").orderBy("us").rangeBetween(-span, -1)
    want = df.withColumn("total", F.when(F.col("k").isNotNull(), F.sum("x").over(frame)))
    assert rows(history.rolling_sum(df, span, {"total": "x"}, key="k")) == rows(want)


@pytest.mark.parametrize("span", [1, 7, 1000, 86_400, 9973, 1 << 20])
def test_rolling_sum(spark, lopsided, all_hot, span):
    ts = F.timestamp_micros((F.col("id") * 37) % 20_000 - 5_000)
    df = lopsided.withColumn("ts", ts)
    sums = {"total": "x", "n": "one"}
    df = df.withColumn("one", F.lit(1.0))
    hot = history.rolling_sum(df, span, sums, key="k")
    cold = history.rolling_sum(df, span, sums, key="k", hot=())
    assert rows(hot) == rows(cold)


def test_no_row_is_both_or_neither(lopsided, all_hot):
    seen = []
    skew.split_plan(lopsided, "k", None, lambda d, h: seen.append(d.count()) or d)
    assert sum(seen) == 9000 and len(seen) == 2


# One query per plan that treats hot keys apart; set ALL_SKEWED for all of them.
SKEWED = (
    "align", "bootstrap_ci", "calibrated_holdout", "entry_history", "join_entity", "leaderboard",
    "lift_top10", "market_gap", "previous_result", "race_log_loss", "race_rank", "race_softmax",
    "recent_training_pit", "rolling_training", "select_bets", "temperature", "upset_type_profile",
    "venue_entries",
)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("ALL_SKEWED") else SKEWED)
def test_queries_on_skewed_tables(spark, skewed_dir, all_hot, name):
    con = oracle_check.connect(skewed_dir)
    got = QUERIES[name](spark, skewed_dir).toPandas()
    assert oracle_check.difference(got, con.execute(ORACLE[name]).df(), 2e-6) is None
