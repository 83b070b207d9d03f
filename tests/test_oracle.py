"""Registered queries against their SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry_points
import oracle_check
from conftest import SMALL

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SMALL)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    assert len(want) > 0
    assert oracle_check.difference(got, want) is None


@pytest.mark.parametrize(
    "name", ["model_rf", "model_logit", "model_svm", "model_upset_odds", "model_importances", "model_two_stage"]
)
def test_models_give_metrics(spark, name):
    out = QUERIES[name](spark, SMALL).toPandas()
    assert len(out) > 0 and out.notna().all().all()


def test_flagship_is_the_market_log_loss(spark):
    row = entry_points.entry(spark).first()
    assert row["races"] > 1000 and row["log_loss"] > 0


def test_figures_of_the_survey(spark):
    sf = "/root/testdata/sf0.01"
    assert QUERIES["race_log_loss"](spark, sf).first()[:2] == (1.609363, 13623)
    grid = {(r["w"], r["t"]): r["log_loss"] for r in QUERIES["calibration_grid"](spark, sf).collect()}
    assert grid[0.1, 1.0] == 1.539469 and grid[0.3, 1.5] == 1.420145
    assert QUERIES["odds_band_roi"](spark, sf).first()[:] == (8498, 2.849537)
