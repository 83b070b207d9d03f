"""What a fit refuses by itself, and what it leaves out and counts."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from furlong.operators import joins, models, select, split

ROLES = {"race_id": "id", "form": "feature", "plcOdds": "market", "win": "label"}


@pytest.fixture(scope="module")
def runners(spark):
    df = spark.range(800).selectExpr(
        "concat('r', id div 8) AS race_id", "cast(id * 7 % 11 as double) AS form", "cast(id % 5 as double) AS plcOdds",
        "cast(id % 8 = id div 8 % 8 as int) AS win",
    )
    return select.with_roles(df, ROLES)


FITS = {
    "fit": lambda df, features, **kw: models.fit(df, features, "win", "logistic", **kw),
    "two_stage": lambda df, features, **kw: models.two_stage(df, df, features, "win", "logistic", folds=2, **kw),
    "cross_validate": lambda df, features, **kw: models.cross_validate(df, features, "win", "logistic", folds=2, **kw),
}


@pytest.mark.parametrize("how", FITS)
def test_columns_without_the_role_are_refused_everywhere(spark, runners, how):
    bare = runners.select(*[F.col(c).alias(c, metadata={}) for c in runners.columns])
    for df, features in ((runners, ["form", "plcOdds"]), (bare, ["form"]), (runners.withColumn("form", F.col("plcOdds") * 1), ["form"])):
        with pytest.raises(ValueError, match="not usable as features"):
            FITS[how](df, features)
    FITS[how](runners, ["form"])
    FITS[how](bare, ["form"], roles=ROLES)
    FITS[how](runners, ["form", "plcOdds"], allow_market=True)


@pytest.mark.parametrize("how", FITS)
def test_resampled_sets_are_refused_everywhere(runners, how):
    source = split.record_base_rate(runners)
    FITS[how](source, ["form"])
    oversampled = source.unionByName(source.where("win = 1"))
    undersampled = source.where("win = 1 OR form < 2")
    for df in (oversampled, undersampled):
        with pytest.raises(ValueError, match="resampled"):
            FITS[how](df, ["form"])


def test_roles_and_base_rates_outlive_files(spark, runners, tmp_path):
    split.record_base_rate(runners).write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert select.roles_of(back) == ROLES and select.roles_of(back.where("win = 1").select("form")) == {"form": "feature"}
    with pytest.raises(ValueError, match="resampled"):
        split.check_base_rate(back.where("win = 1"))
    split.check_base_rate(back)
    split.check_base_rate(back.where("race_id < 'r5'"))


@pytest.mark.parametrize("learner", ["random_forest", "logistic"])
def test_unknown_labels_do_not_train_and_are_counted(runners, learner):
    gaps = runners.withColumn("win", F.when(F.col("form") != 3, F.col("win")))
    model = models.fit(gaps, ["form"], "win", learner)
    assert model.null_labels == gaps.where("win IS NULL").count() > 0
    assert models.score(model, gaps).count() == 800
    with pytest.raises(ValueError, match="no row has a label"):
        models.fit(gaps.where("win IS NULL"), ["form"], "win", learner)


def test_feature_counts_are_nested_and_ranked_on_train_only(spark):
    """A column that only the test rows' labels follow is never picked."""
    df = spark.range(2000).selectExpr(
        "id", "cast(xxhash64(id) % 2 = 0 as int) AS win", "cast(xxhash64(id, 1) % 100 as double) AS noise", "id < 1500 AS train"
    )
    df = df.withColumn("good", F.col("win") + (F.xxhash64("id", F.lit(2)) % 100) / 200)
    df = df.withColumn("leak", F.when(~F.col("train"), F.col("win").cast("double")).otherwise(F.lit(0.0)))
    roles = {"noise": "feature", "good": "feature", "leak": "feature"}
    got = models.feature_counts(df.where("train"), df.where("NOT train"), list(roles), (1, 2), roles=roles).collect()
    assert [r["features"] for r in got] == ["good", "good noise"] and all(0.5 < r["auc"] <= 1 for r in got)


def test_sides_that_do_not_line_up_are_refused(spark):
    keys = ["race_id", "hrNo"]
    a = spark.createDataFrame([("r", "x", 0.4), ("r", "y", 0.6)], "race_id string, hrNo string, model double")
    m = a.withColumnRenamed("model", "market")
    y = a.select(*keys, F.lit(1).alias("win"))
    assert joins.align(a, m, y, keys).count() == 2
    lost, twice = m.where("hrNo = 'x'"), y.unionByName(y.where("hrNo = 'x'"))
    for sides in ((a, lost, y), (a, m, twice), (a.where("hrNo = 'x'"), m, y)):
        with pytest.raises((PySparkException, Py4JJavaError), match="do not line up"):
            joins.align(*sides, keys).collect()
