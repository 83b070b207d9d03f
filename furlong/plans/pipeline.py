"""The three analyses from entry files to results.

``prepare`` makes the dataset versions, ``against_market`` compares and blends a
win model with the odds, ``upsets`` turns an upset model into bets. They hand
tables on as files, like separate jobs would.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong import settings
from furlong.operators import (
    bootstrap,
    calibration,
    history,
    joins,
    metrics,
    models,
    preprocess,
    race,
    select,
    split,
    strategy,
)
from furlong.scale.storage import lay_down
from furlong.sources import entries as io
from furlong.sources.schema import ENTRY_SCHEMA, with_features

ENTRY_KEYS = ("race_id", "hrNo")
# Columns every dataset version keeps next to its features, the latter where the files have them.
CARRIED = ("race_id", "race_date", "hrNo", "winOdds", "win")
ALSO_CARRIED = ("jkNo", "trNo", "owNo", "upset_A", "upset_B")
# What the runner's earlier starts add to an upset model.
HISTORY = ("prior_starts", "rest_days", "prev_win", "debut")


def prepare(
    spark: SparkSession,
    paths: Sequence[str],
    base: str,
    venue: str,
    features: Sequence[str],
    roles: Mapping[str, str],
    max_vif: float | None = None,
    partitions: int | None = None,
) -> list[str]:
    """Raw entry files of any venues to the named dataset versions of one venue.

    Returns the features that were kept.
    """
    select.check_features(features, roles)
    schema = with_features(ENTRY_SCHEMA, features)
    raw = select.union_venues(*[io.read_entries(spark, p, schema, partitions) for p in paths])
    one = select.drop_post_race(select.filter_venue(raw, venue), roles)
    carried = [*CARRIED, *[c for c in ALSO_CARRIED if c in one.columns and c not in features]]
    kept = select.project_model_columns(one, [*carried, *features])
    rows = lay_down(split.time_split(kept), "entries")
    used = list(features)
    if max_vif is not None:
        used = preprocess.drop_collinear(rows.where("split = 'train'"), used, max_vif)
    versions = split.record_base_rate(rows.select(*carried, *used, "split"), of=rows.where("split = 'train'"))
    preprocess.build_versions(versions, base, used)
    return used


def _read(spark, base, version, purpose) -> dict[str, DataFrame]:
    io.guard_version(version, purpose)
    return {s: io.read_split(spark, base, version, s, purpose) for s in ("train", "valid", "test")}


def against_market(
    spark: SparkSession,
    base: str,
    results: str,
    holdout_id: str,
    features: Sequence[str],
    roles: Mapping[str, str],
    version: str = "v1_base",
    learner: str = "random_forest",
    weights: Iterable[float] = (0.0, 0.05, 0.1, 0.2, 0.3),
    temperatures: Iterable[float] = (0.8, 0.9, 1.0, 1.1, 1.25, 1.5),
    replicates: int = settings.REPLICATES,
    others: Sequence[str] = (),
) -> DataFrame:
    """Win model, market, their calibrated blend, and other learners on the test split, once.

    Weight and temperature come from the valid split. Model and market side are made
    separately and must line up. Writes ``win_metrics``, ``win_gap`` (model minus
    market), ``win_gain`` and ``win_policy`` under ``results`` and returns the metrics.
    """
    parts = _read(spark, base, version, "train")
    model = models.fit(parts["train"], features, "win", learner, roles)
    further = {name: models.fit(parts["train"], features, "win", name, roles) for name in others}

    def probabilities(df: DataFrame) -> DataFrame:
        scored = models.score(model, df.select(*ENTRY_KEYS, *features), "score")
        model_side = race.race_normalize(scored, "score", "model").select(*ENTRY_KEYS, "model")
        market_side = race.market_prob(df.select(*ENTRY_KEYS, "winOdds"), "winOdds", "market")
        both = joins.align(model_side, market_side, df.select(*ENTRY_KEYS, "win"), ENTRY_KEYS)
        cols = [*ENTRY_KEYS, "winOdds", "win", "market", "model"]
        return lay_down(both.select(*cols), "probabilities")

    choice = calibration.calibrate(probabilities(parts["valid"]), weights, temperatures)

    def final(test: DataFrame) -> DataFrame:
        rows = lay_down(
            calibration.apply_calibration(probabilities(test), choice, name="blend"), "blend"
        )
        measured = [
            models.evaluate(rows, name, ["hrNo"], name) for name in ("market", "model", "blend")
        ]
        for name, other in further.items():
            scored = models.score(other, test.select(*ENTRY_KEYS, "win", *features))
            measured.append(models.evaluate(lay_down(scored.select(*ENTRY_KEYS, "win", "p"), "other"), name, ["hrNo"]))
        board = metrics.leaderboard(measured, ["auc", "log_loss", "top1_rate"])
        io.write_result(board, results, "win_metrics")
        io.write_result(metrics.market_gap(rows, "model", "market", ["hrNo"]), results, "win_gap")
        gains = bootstrap.gains_in(rows, "market", "blend")
        gain = bootstrap.gain_ci(gains, count=replicates).withColumns(
            {"w": F.lit(choice.weight), "t": F.lit(choice.temperature)}
        )
        io.write_result(gain, results, "win_gain")
        io.write_result(strategy.bet_gate(rows, "blend", "winOdds"), results, "win_policy")
        return io.read_result(spark, results, "win_metrics")

    return split.score_once(
        f"{results}/holdout_ledger", holdout_id, f"{version}/{learner}", parts["test"], final
    )


def with_history(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All splits together, with what each runner's strictly earlier starts tell."""
    rows = reduce(DataFrame.unionByName, parts.values())
    days = history.start_days(rows, finish=None, wins="win")
    days = history.prior_starts(history.rest_days(history.previous_result(days.withColumn("result", F.col("wins")), name="prev_win")))
    full = history.attach_history(rows, days, ["prior_starts", "rest_days", "prev_win"])
    full = full.withColumns(
        {
            "debut": (F.col("prior_starts") == 0).cast("int"),
            "rest_days": F.coalesce("rest_days", F.lit(0)),
            "prev_win": F.coalesce("prev_win", F.lit(0)),
        }
    )
    return select.with_roles(full, dict.fromkeys(HISTORY, "feature"))


def upsets(
    spark: SparkSession,
    base: str,
    results: str,
    features: Sequence[str],
    roles: Mapping[str, str],
    version: str = "v1_base",
    learner: str = "random_forest",
    with_odds: bool = False,
    replicates: int = settings.REPLICATES,
) -> DataFrame:
    """Upset model on the test split, what drives it, its lift, and the bets it selects.

    The runner's history is a feature beside ``features``. Writes under ``results``
    ``upset_effects`` (upset rate by feature bin) and ``upset_types`` (profile of the
    upsets by type), both of train, ``upset_drivers`` (importances of a tree model, else
    correlations), ``upset_lift``, ``upset_bets`` and ``upset_return``; returns the last.
    """
    parts = _read(spark, base, version, "train")
    used = [*features, *HISTORY, *(["winOdds"] if with_odds else [])]
    labelled = strategy.upset_type(strategy.upset_label(with_history(parts), odds="winOdds"))
    rows = lay_down(labelled.select(*CARRIED, "split", "type", "upset", *features, *HISTORY), "upset-entries")
    train = split.record_base_rate(rows.where("split = 'train'"), "upset")
    model = models.fit(train, used, "upset", learner, roles, with_odds)

    io.write_result(strategy.feature_effect(train, used, "upset"), results, "upset_effects")
    won = lay_down(train.where("upset = 1").select("type", "winOdds", *HISTORY), "upset-won")
    io.write_result(strategy.profile_by_type(won, ["winOdds", "rest_days", "prior_starts"]), results, "upset_types")
    tree = hasattr(model.stages[-1], "featureImportances")
    drivers = models.importances(model, used) if tree else strategy.feature_correlation(train, used, "upset")
    io.write_result(drivers, results, "upset_drivers")

    scored = models.score(model, rows.where("split = 'test'"))
    tested = lay_down(scored.select(*ENTRY_KEYS, "winOdds", "win", "upset", "p"), "upsets")
    flagged = select.top_flag(tested, "p", ENTRY_KEYS)
    io.write_result(bootstrap.lift_ci(flagged, "top", "upset", count=replicates), results, "upset_lift")
    io.write_result(strategy.select_bets(tested, "p", ENTRY_KEYS, odds="winOdds"), results, "upset_bets")
    bets = io.read_result(spark, results, "upset_bets")
    share = bootstrap.prob_profit(bets, "winOdds", count=replicates)
    out = metrics.beside(metrics.roi(bets, "winOdds"), share)
    io.write_result(out, results, "upset_return")
    return io.read_result(spark, results, "upset_return")
