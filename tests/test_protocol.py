"""Splits, leakage guards, the hold-out ledger and history properties."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from furlong.operators import history, joins, models, preprocess, select, split
from furlong.plans import tables as t
from furlong.scale import storage

SMALL = "/root/testdata/sf0.001"


def test_splits_are_disjoint_in_date_cover_all_rows_and_keep_the_order(spark):
    rows = t.dated_runners(spark, SMALL)
    out = split.time_split(rows)
    spans = {
        r["split"]: r
        for r in out.groupBy("split")
        .agg(F.min("race_date").alias("a"), F.max("race_date").alias("b"), F.count("*").alias("n"))
        .collect()
    }
    assert sum(s["n"] for s in spans.values()) == rows.count() == 6000
    assert spans["train"]["b"] < spans["valid"]["a"] <= spans["valid"]["b"] < spans["test"]["a"]
    assert spans["train"]["n"] <= 3600 < 3600 + spans["valid"]["n"]


def test_split_cuts_reach_the_scan_as_literals(spark):
    rows = t.dated_runners(spark, SMALL).select("race_date")
    out = split.time_split(rows).where("split = 'train'")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_date_only_goes_to_test(spark):
    df = spark.range(4).select(F.lit("2024-01-01").cast("date").alias("race_date"))
    assert {r["split"] for r in split.time_split(df).collect()} == {"test"}


def test_a_race_stays_in_one_fold(spark):
    out = split.kfold(t.runners(spark, SMALL), 5)
    assert out.groupBy("race_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    assert out.select("fold").distinct().count() == 5


def test_holdout_is_scored_once_per_model(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    df = spark.range(3)
    assert split.score_once(ledger, "h1", "m0", df, lambda d: d.count()) == 3
    assert split.score_once(ledger, "h1", "m2", df, lambda d: d.count()) == 3
    with pytest.raises(PermissionError):
        split.score_once(ledger, "h1", "m0", df, lambda d: d.count())


def test_weights_and_resampling_are_refused(spark):
    with pytest.raises(ValueError, match="weight"):
        split.assert_unweighted(LogisticRegression(weightCol="w"))
    split.assert_unweighted(LogisticRegression())
    source = spark.createDataFrame([(1,), (0,), (0,)], "win int")
    with pytest.raises(ValueError, match="base rate"):
        split.assert_unweighted(train=source.unionByName(source.where("win = 1")), source=source)
    split.assert_unweighted(train=source, source=source)


def test_market_result_and_label_are_refused_as_features(spark):
    for bad in ("odds", "qty", "win", "hrNo"):
        with pytest.raises(ValueError, match=bad):
            select.check_features(["tax", bad], t.ROLES)
    for allow in (False, True):
        with pytest.raises(ValueError, match="plcOdds"):
            select.check_features(["tax", "plcOdds"], t.ROLES, allow)
    assert select.check_features(["tax", "odds"], t.ROLES, allow_market=True) == ["tax", "odds"]
    with pytest.raises(ValueError):
        select.check_features(["tax", "qty"], t.ROLES, allow_market=True)


def test_fit_refuses_a_market_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], "tax double, odds double, win int")
    with pytest.raises(ValueError, match="odds"):
        models.fit(df, ["tax", "odds"], "win", "logistic", t.ROLES)


def test_training_reads_a_stored_table_in_small_splits(spark, tmp_path, monkeypatch):
    rows = spark.range(200_000, numPartitions=2).select(
        F.rand(3).alias("a"), F.rand(4).alias("b"), (F.col("id") % 2).alias("win")
    )
    rows.write.parquet(str(tmp_path / "rows"))
    train = spark.read.parquet(str(tmp_path / "rows"))
    conf, fit = "spark.sql.files.maxPartitionBytes", models.Pipeline.fit
    before, seen = spark.conf.get(conf), []

    def counted(pipeline, data):
        seen.append(data.rdd.getNumPartitions())
        return fit(pipeline, data)

    monkeypatch.setattr(models, "TRAINING_SPLIT", 1 << 18, raising=False)
    monkeypatch.setattr(models.Pipeline, "fit", counted)
    models.fit(train, ["a", "b"], roles={"a": "feature", "b": "feature"})
    assert seen[0] >= 10
    assert spark.conf.get(conf) == before


def test_small_splits_overlap_and_end(spark):
    conf = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(conf)
    first, second = storage.small_splits(spark, 1 << 20), storage.small_splits(spark, 1 << 20)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(conf) == str(1 << 20)
    second.__exit__(None, None, None)
    assert spark.conf.get(conf) == before
    with pytest.raises(KeyError), storage.small_splits(spark, 1 << 50):
        assert spark.conf.get(conf) == before
        raise KeyError
    assert spark.conf.get(conf) == before


def test_drops_by_role(spark):
    df = t.entries(spark, SMALL)
    kept = select.drop_market(select.drop_post_race(df, t.ROLES), t.ROLES)
    assert not {"odds", "price", "qty", "returnflag"} & set(kept.columns)
    assert "odds" in select.drop_market(df, t.ROLES, allow_market=True).columns
    with pytest.raises(ValueError):
        select.project_model_columns(df, ["tax", "nothing"])


def test_future_rows_never_change_earlier_features(spark):
    ranked = t.finishes(spark, SMALL).cache()
    limit = F.lit("1999-01-01").cast("date")

    def features(df):
        days = history.start_days(df, qty_sum="qty")
        days = history.prior_starts(history.rest_days(history.previous_result(days)))
        days = history.prior_mean(days, "qty_sum")
        return days.select("hrNo", "race_date", "prev_result", "rest_days", "prior_starts", "prior_mean")

    past = features(ranked).where(F.col("race_date") < limit)
    changed = ranked.withColumn(
        "qty", F.when(F.col("race_date") >= limit, F.col("qty") * 100).otherwise(F.col("qty"))
    ).where((F.col("race_date") < limit) | (F.col("gate") > 3))
    again = features(changed).where(F.col("race_date") < limit)
    assert past.exceptAll(again).isEmpty() and again.exceptAll(past).isEmpty()
    ranked.unpersist()


def test_training_on_or_after_the_start_does_not_count(spark):
    log = spark.createDataFrame(
        [("h", "2024-01-01 00:00:00", 1.0), ("h", "2024-01-02 12:00:00", 2.0),
         ("h", "2024-01-08 00:00:00", 4.0), ("g", "2024-01-07 00:00:00", 8.0),
         ("h", "2024-01-09 00:00:00", 16.0)],
        "hrNo string, ts string, amount double",
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    starts = spark.createDataFrame(
        [(1, "h", "2024-01-08 00:00:00"), (2, "x", "2024-01-08 00:00:00")], "id int, hrNo string, ts string"
    ).withColumn("ts", F.to_timestamp_ntz("ts"))
    out = {r["id"]: (r["training"], r["sessions"]) for r in history.recent_training(starts, log, 7).collect()}
    assert out == {1: (3.0, 2), 2: (0.0, 0)}


def test_zone_free_timestamps_ignore_clock_changes(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, "1969-12-31 23:59:59.999999"), (2, "2024-03-10 02:30:00"), (3, "2024-03-10 03:30:00.25")]
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
            got = [r[0] for r in df.orderBy("id").select(history.micros(df, "ts")).collect()]
            assert got == [-1, 1_710_037_800_000_000, 1_710_041_400_250_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entity_join_keeps_leading_zeros_and_unmatched_rows(spark):
    entries = spark.createDataFrame([("0012",), ("12",), (None,)], "hrNo string")
    horses = spark.createDataFrame([("0012", "a")], "hrNo string, name string")
    out = {r["hrNo"]: r["name"] for r in joins.join_entity(entries, horses, "hrNo").collect()}
    assert out == {"0012": "a", "12": None, None: None}
    with pytest.raises(TypeError):
        joins.join_entity(entries.withColumn("hrNo", F.col("hrNo").cast("int")), horses, "hrNo")


def test_alignment_notices_lost_rows(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5)], "race_id int, hrNo string, p double")
    m = a.withColumnRenamed("p", "m")
    y = a.withColumnRenamed("p", "win")
    assert joins.assert_aligned(a, m, y, ["race_id", "hrNo"]).count() == 2
    with pytest.raises(ValueError, match="line up"):
        joins.assert_aligned(a, m.where("hrNo = 'x'"), y, ["race_id", "hrNo"])


def test_grid_rows(spark):
    out = joins.grid(spark.range(3), [0.0, 0.1], [1.0, 2.0, 3.0])
    assert out.count() == 18 and out.select("w", "t").distinct().count() == 6


def test_fitted_values_come_from_train_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    test = spark.createDataFrame([(None,), (500.0,)], "x double")
    out = [(r["x"], r["x_missing"]) for r in preprocess.impute(train, test, ["x"]).collect()]
    assert out == [(2.0, 1), (500.0, 0)]
    clipped = preprocess.winsorize(train, test, ["x"], (0.0, 1.0)).collect()
    assert [r["x"] for r in clipped] == [None, 3.0]
    scaled = preprocess.standardize(train, test, ["x"]).collect()
    assert scaled[1]["x"] == 498.0


def test_constant_column_is_scaled_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in preprocess.standardize(df, df, ["x"]).collect()] == [0.0, 0.0]


def test_collinear_columns_are_dropped_one_by_one(spark):
    df = spark.range(2000).select(
        F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("noise")
    ).withColumn("sum", F.col("a") + F.col("b") + 0.01 * F.col("noise"))
    kept = preprocess.drop_collinear(df, ["a", "b", "sum"], 5.0)
    assert len(kept) == 2
    exact = df.withColumn("twin", F.col("a") * 2)
    assert len(preprocess.drop_collinear(exact, ["a", "twin", "b"], 5.0)) == 2
    assert preprocess.drop_collinear(df, ["a", "b"], 5.0) == ["a", "b"]


def test_only_described_versions_have_a_recipe():
    assert callable(preprocess.recipe("v1_base"))
    with pytest.raises(KeyError):
        preprocess.recipe("v3")
