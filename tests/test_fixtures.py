"""Small inputs with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from furlong.operators import calibration, history, metrics, race, select, split, strategy

KEYS = ["race_id", "hrNo"]


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def three(spark):
    rows = [("r", "a", 2.0, 0, 0.2), ("r", "b", 4.0, 1, 0.5), ("r", "c", 8.0, 0, 0.3)]
    return spark.createDataFrame(rows, "race_id string, hrNo string, odds double, win int, model double")


def values(df, col):
    return [r[col] for r in df.orderBy("hrNo").collect()]


def test_market_probability(three):
    assert values(race.market_prob(three), "p") == pytest.approx([4 / 7, 2 / 7, 1 / 7])


def test_overround_times_payout_is_one(three):
    row = one(metrics.payout_rate(three))
    assert row["mean_overround"] == pytest.approx(0.875)
    assert row["payout_rate"] * row["mean_overround"] == pytest.approx(1)


def test_race_log_loss(three):
    row = one(metrics.race_log_loss(race.market_prob(three), "p"))
    assert row["log_loss"] == pytest.approx(1.252763, abs=1e-6)
    assert (row["races"], row["excluded"]) == (1, 0)


def test_dead_heat_and_lone_runner_are_counted_as_excluded(spark):
    rows = [(1, "a", 0.5, 1), (1, "b", 0.5, 1), (2, "a", 1.0, 1), (3, "a", 0.25, 1), (3, "b", 0.75, 0)]
    df = spark.createDataFrame(rows, "race_id int, hrNo string, p double, win int")
    row = one(metrics.race_log_loss(df, "p"))
    assert (row["races"], row["excluded"]) == (1, 2)
    assert row["log_loss"] == pytest.approx(-math.log(0.25))
    assert one(metrics.top1_rate(df, "p", ["hrNo"])) == {"top1_rate": 0.0, "races": 1}


def test_normalising_inside_the_aggregation_equals_the_window(three):
    scored = three.withColumn("s", F.lit(1.0) / F.col("odds"))
    fused = metrics.race_table(scored, ["s"], ["hrNo"], normalize=True)
    plain = metrics.race_table(race.race_normalize(scored, "s", "q"), ["q"], ["hrNo"])
    assert one(fused)["loss_s"] == pytest.approx(one(plain)["loss_q"])
    assert one(fused)["hit_s"] == one(plain)["hit_q"] == 0


def test_temperature(three):
    p = race.market_prob(three)
    warm = race.adjust_temperature(p, "p", 2.0)
    assert values(warm, "p_t") == pytest.approx([0.453082, 0.320377, 0.226541], abs=1e-6)
    same = race.adjust_temperature(p, "p", 1.0)
    assert values(same, "p_t") == pytest.approx(values(p, "p"))


def test_blend(three):
    p = race.market_prob(three)
    mixed = race.blend(p, "p", "model", 0.1)
    assert values(mixed, "p_blend") == pytest.approx([0.534286, 0.307143, 0.158571], abs=1e-6)
    assert values(race.blend(p, "p", "model", 0.0), "p_blend") == pytest.approx(values(p, "p"))


def test_geometric_blend(three):
    p = race.market_prob(three)
    out = values(race.blend(p, "p", "model", 0.5, geometric=True), "p_blend")
    raw = [math.sqrt(a * b) for a, b in zip((4 / 7, 2 / 7, 1 / 7), (0.2, 0.5, 0.3))]
    assert out == pytest.approx([x / sum(raw) for x in raw])


def test_softmax_does_not_overflow(spark):
    df = spark.createDataFrame([(1, "a", 1000.0), (1, "b", 1000.0 - math.log(3))], "race_id int, hrNo string, s double")
    assert values(race.race_softmax(df, "s"), "p") == pytest.approx([0.75, 0.25])


def test_auc_with_a_tie(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)], "s double, win int")
    row = one(metrics.roc_auc(df, "s"))
    assert row == {"auc": 0.875, "positives": 2, "negatives": 2}


def test_auc_is_kept_by_monotone_maps_and_flipped_by_the_sign(spark):
    df = spark.range(5000).select(
        (F.sin("id") * 3).alias("s"), (F.col("id") % 7 == 0).cast("int").alias("win")
    )
    df = df.withColumns({"e": F.exp("s"), "n": -F.col("s")})
    auc = [one(metrics.roc_auc(df, c))["auc"] for c in ("s", "e", "n")]
    assert auc[0] == pytest.approx(auc[1], abs=1e-12)
    assert auc[0] == pytest.approx(1 - auc[2], abs=1e-12)


def test_auc_equals_the_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(20000).select(
        F.round(F.rand(3) * 500).alias("s"), (F.rand(4) < 0.3).cast("double").alias("win")
    ).cache()
    exact = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="win", numBins=0).evaluate(df)
    assert one(metrics.roc_auc(df, "s"))["auc"] == pytest.approx(exact, abs=1e-12)
    df.unpersist()


def test_auc_task_code_does_not_need_this_package():
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read())"
    run = subprocess.run(
        [sys.executable, "-I", "-c", code], input=cloudpickle.dumps(metrics._pair_counter()),
        capture_output=True, cwd="/",
    )
    assert run.returncode == 0, run.stderr


def test_auc_without_negatives_is_null(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1)], "s double, win int")
    assert one(metrics.roc_auc(df, "s"))["auc"] is None


def test_lift(spark):
    rows = [(i, float(i), int(i in (9, 3))) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, s double, win int")
    row = one(metrics.lift_at(df, "s", ["k"], share=0.1))
    assert (row["lift"], row["k"]) == (5.0, 1)


def test_roi(spark):
    df = spark.createDataFrame([(12.0, 1), (20.0, 0), (15.0, 0)], "odds double, win int")
    assert one(metrics.roi(df)) == {"bets": 3, "roi": 3.0}


def test_expected_return_and_stakes(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.3, 4.0), (0.1, 8.0)], "p double, odds double")
    out = metrics.with_expected_return(strategy.allocate(df, 1.0)).orderBy("odds").collect()
    assert [r["expected_return"] for r in out] == pytest.approx([0.5, 0.2, -0.2])
    assert [r["stake"] for r in out] == pytest.approx([0.25, 0.066667, 0.0], abs=1e-6)
    assert one(strategy.bet_gate(df))["policy"] == "bet"
    assert one(strategy.bet_gate(df.where("odds = 8")))["policy"] == "no_bet"
    assert select.positive_return(df).count() == 2


def test_odds_band_has_both_ends(spark):
    df = spark.createDataFrame([(9.99,), (10.0,), (50.0,), (50.01,)], "odds double")
    assert sorted(r[0] for r in select.odds_band(df).collect()) == [10.0, 50.0]


def test_history_counts_strictly_earlier_dates(spark):
    rows = [("h", d, f) for d, f in (("2024-01-01", 3), ("2024-01-05", 5), ("2024-01-05", 2), ("2024-01-09", 1))]
    df = spark.createDataFrame(rows, "hrNo string, race_date string, finish int").withColumn(
        "race_date", F.to_date("race_date")
    )
    days = history.start_days(df)
    days = history.prior_starts(history.rest_days(history.previous_result(days)))
    out = history.attach_history(df, days, ["rest_days", "prior_starts", "prev_result"])
    got = out.orderBy("race_date", F.col("finish").desc()).collect()
    assert [r["rest_days"] for r in got] == [None, 4, 4, 4]
    assert [r["prior_starts"] for r in got] == [0, 1, 1, 2]
    assert [r["prev_result"] for r in got] == [None, 3, 3, 2]


def test_time_split_of_five_equal_dates(spark):
    df = spark.range(100).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("race_date")
    )
    out = split.time_split(df).select("race_date", "split").distinct().orderBy("race_date").collect()
    assert [r["split"] for r in out] == ["train"] * 3 + ["valid", "test"]


def test_upset_label_and_types(spark):
    rows = [(1, 10.0, 0, None), (1, 9.9, 3, 5), (1, 30.0, 12, 90), (1, 30.0, 12, 10), (0, 30.0, 4, 10)]
    df = spark.createDataFrame(rows, "win int, odds double, prior_starts int, rest_days int")
    out = strategy.upset_type(strategy.upset_label(df)).collect()
    assert [r["upset"] for r in out] == [1, 0, 1, 1, 0]
    assert [r["type"] for r in out] == ["debut", "rookie", "veteran_return", "other", "rookie"]


def test_strategies_as_predicates(spark):
    df = spark.createDataFrame([(12.0, 1), (20.0, 0), (2.0, 1)], "odds double, win int")
    out = strategy.compare_strategies(df, {"long": F.col("odds") > 5, "none": F.col("odds") > 99})
    got = {r["strategy"]: (r["bets"], r["roi"]) for r in out.collect()}
    assert got == {"long": (2, 5.0), "none": (0, None)}


def test_roi_bands_with_total(spark):
    df = spark.createDataFrame([(5.0, 1), (10.0, 0), (60.0, 1)], "odds double, win int")
    out = {r["band"]: (r["bets"], r["roi"]) for r in metrics.roi_by_band(df, [10, 50], with_total=True).collect()}
    assert out == {0: (1, 4.0), 1: (1, -1.0), 2: (1, 59.0), None: (3, pytest.approx(65 / 3 - 1))}


def test_grid_of_losses_equals_each_point_alone(spark, three):
    rows = race.race_normalize(race.market_prob(three, name="market"), "model", "model")
    for point in calibration.calibration_grid(rows, [0.0, 0.2], [0.7, 1.0]).collect():
        choice = calibration.Choice(point["w"], point["t"], 0.0)
        alone = metrics.race_log_loss(calibration.apply_calibration(rows, choice), "p")
        assert one(alone)["log_loss"] == pytest.approx(point["log_loss"])
    with pytest.raises(ValueError):
        calibration.calibrate(rows.limit(0), [0.0], [1.0])


@pytest.mark.parametrize("n, share, k", [(10, 0.1, 1), (11, 0.1, 2), (30, 0.1, 3), (0, 0.1, 0), (1000, 0.007, 7)])
def test_top_count(n, share, k):
    assert select.top_count(n, share) == k
