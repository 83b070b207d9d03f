"""Physical plans keep their shape: few shuffles, narrow scans, no single-task windows."""

import re

import pytest

from furlong.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    """Physical plans as a large cluster would see them: nothing small enough to broadcast."""

    def of(name):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    return of


def shuffles(text):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", text))


@pytest.mark.parametrize("name", ["market_prob", "race_rank", "temperature", "race_log_loss", "race_softmax"])
def test_race_chains_take_one_shuffle(plan, name):
    assert shuffles(plan(name)) == 1


@pytest.mark.parametrize("name", ["rolling_training", "recent_training_pit"])
def test_rolling_sums_take_one_shuffle(plan, name):
    assert shuffles(plan(name)) == 1


def test_dated_entries_share_the_join_shuffle(plan):
    """Two sides of the join, the history table twice, and one more by race."""
    text = plan("blend")
    assert text.count("hashpartitioning(race_id") + text.count("hashpartitioning(l_orderkey") == 5
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(
    "name",
    ["market_prob", "entry_history", "rolling_training", "recent_training_pit", "blend", "select_bets",
     "impute_median", "compare_strategies", "calibration_grid", "venue_entries"],
)
def test_no_cross_join_and_no_window_over_all_rows(plan, name):
    text = plan(name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    windows = [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]
    assert all(re.search(r"\], \[\w+#\d+", line) for line in windows)


def test_scans_read_only_what_is_used(plan):
    text = plan("market_prob")
    columns = re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    assert sorted(c.split("#")[0] for c in columns.split(",")) == ["l_extendedprice", "l_orderkey"]


def test_cut_and_venue_filters_reach_the_scan(plan):
    assert "GreaterThanOrEqual(score" in plan("top_fraction")
    assert "EqualTo(r_name,ASIA)" in plan("venue_entries")


@pytest.mark.parametrize("name", ["model_logit", "model_comparison"])
def test_a_model_query_makes_its_own_table_once(spark, monkeypatch, name):
    """What a query costs does not depend on the queries before it."""
    from furlong.plans import queries, tables

    made = []

    class Made(Exception):
        pass

    def features(spark, sf):
        made.append(sf)
        raise Made

    monkeypatch.setattr(tables, "features", features)
    for n in (1, 2):
        with pytest.raises(Made):
            queries.QUERIES[name](spark, SMALL)
        assert len(made) == n


def test_tasks_by_race_and_runner_follow_the_rows(spark, plan, monkeypatch):
    from furlong.plans import tables

    few = tables.parts(spark, SMALL)
    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    assert few == 2 and tables.parts(spark, SMALL) == rows // 200
    for name in ("previous_result", "entry_history"):
        assert re.search(rf"hashpartitioning\(hrNo#\d+, {rows // 200}\)", plan(name))


def test_scores_are_joined_in_tasks_that_follow_the_rows(spark, plan, monkeypatch):
    """Runs of the history and its join to the entries, not only the grouping by race."""
    from furlong.plans import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 200)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 200
    text = plan("positive_return")
    dealt = re.findall(r"Exchange hashpartitioning\(hrNo#\d+(, race_date#\d+)?, (\d+)\)", text)
    assert {int(x) for _, x in dealt} == {n}
    assert [bool(date) for date, _ in dealt].count(False) == 1 and len(dealt) == 3


def test_a_comparison_fits_the_forest_once_and_models_side_by_side(spark, monkeypatch):
    """Once on all of train and once a fold; at most so many fits run at once, and two do."""
    import threading

    from furlong import settings
    from furlong.operators import models
    from furlong.plans import queries

    fit, lock = models.fit, threading.Lock()
    learners, running, most = [], [0], [0]

    def cheap(train, features, label="win", learner="random_forest", *args, **kw):
        with lock:
            learners.append(learner)
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(train, features, label, "logistic", *args, **kw)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models, "fit", cheap)
    out = queries.QUERIES["model_comparison"](spark, SMALL)
    assert learners.count("random_forest") == settings.FOLDS + 1
    assert most[0] == queries.MODELS_AT_ONCE
    assert {r["model"] for r in out.select("model").collect()} == {"rf", "gbt", "gbt_wide", "logit", "svm", "two_stage"}
