"""The registered queries: operators applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
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
from furlong.plans import tables as t
from furlong.scale.ordering import with_group_rank
from furlong.scale.storage import lay_down

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Grid of the registered calibration queries.
WEIGHTS = (0.0, 0.1, 0.3)
TEMPERATURES = (0.8, 1.0, 1.5)
# The blend the registered comparisons use.
BLEND = calibration.Choice(0.3, 1.5, 0.0)
# Edges of the registered odds bands.
BANDS = (2.0, 5.0, 10.0, 20.0, 50.0)
# Models of a comparison that are fitted side by side. Each holds its training rows; the
# second fills the cores that the many short passes of the first leave idle.
MODELS_AT_ONCE = 2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def r9(c: str) -> Column:
    """For values that are simple fractions: six digits would often end on a half."""
    return F.round(F.col(c), 9).alias(c)


def day(c: str = "race_date") -> Column:
    return F.col(c).cast("string").alias(c)


def ranked_score(c: str) -> Column:
    """A score to order by: its first 33 binary digits, whatever its size.

    What sums in another order change is far behind them.
    """
    spread = F.col(c) * F.lit(1048577.0)
    return spread - (spread - F.col(c))


# -- market ----------------------------------------------------------------


@query
def market_prob(spark, sf):
    return t.priced(spark, sf).select(*t.KEYS, r6("p"))


@query
def overround(spark, sf):
    return metrics.overround(t.entries(spark, sf)).select("race_id", r6("overround"))


@query
def payout_rate(spark, sf):
    return metrics.payout_rate(t.entries(spark, sf)).select(
        r6("payout_rate"), r6("mean_overround"), "races"
    )


@query
def race_log_loss(spark, sf):
    return metrics.race_log_loss(t.priced(spark, sf), "p").select(
        r6("log_loss"), "races", "excluded"
    )


@query
def top1_rate(spark, sf):
    return metrics.top1_rate(t.priced(spark, sf), "p", ["price"]).select(r6("top1_rate"), "races")


@query
def race_rank(spark, sf):
    ranked = t.priced(spark, sf, lambda df, hot: race.race_rank(df, "p", ["price"], hot=hot))
    return ranked.select(*t.KEYS, "rk")


@query
def race_favourites(spark, sf):
    best = race.race_favourites(t.priced(spark, sf).select(*t.KEYS, "p", "win"), "p", ["price"])
    return best.select(*t.KEYS, r6("p"), F.col("win").cast("bigint").alias("win"))


@query
def roc_auc(spark, sf):
    return metrics.roc_auc(t.priced(spark, sf), "p").select(
        r6("auc"), "positives", "negatives"
    )


@query
def base_rate(spark, sf):
    return metrics.base_rate(t.entries(spark, sf)).select(r6("base_rate"), "entries")


def _scored(spark, sf):
    """Entries with the model score, stored: selections read them more than once."""
    rows = t.modelled(spark, sf).withColumn("score", ranked_score("model"))
    return lay_down(rows.select(*t.KEYS, "odds", "win", "score"), "scored")


@query
def lift_top10(spark, sf):
    scored = _scored(spark, sf)
    return metrics.lift_at(scored, "score", t.KEYS).select(
        r6("lift"), r6("top_rate"), r6("base_rate"), "k"
    )


@query
def top_fraction(spark, sf):
    rows = t.priced(spark, sf).withColumn("score", ranked_score("p"))
    scored = lay_down(rows.select(*t.KEYS, "score"), "scored")
    return select.top_fraction(scored, "score", t.KEYS).select(*t.KEYS)


# -- history ---------------------------------------------------------------


@query
def previous_result(spark, sf):
    return t.form(spark, sf).select(
        "hrNo", day(), F.col("prev_result").cast("bigint").alias("prev_result")
    )


@query
def rest_days(spark, sf):
    return t.form(spark, sf).select("hrNo", day(), "rest_days")


@query
def prior_starts(spark, sf):
    return t.form(spark, sf).select("hrNo", day(), "prior_starts")


@query
def entry_history(spark, sf):
    full = t.with_form(spark, sf)
    return full.select(*t.KEYS, "prev_result", "rest_days", "prior_starts")


@query
def rolling_training(spark, sf):
    rolled = history.rolling_sum(t.all_training(spark, sf), 7 * 86_400_000_000, {"recent": "amount"})
    return rolled.select("event_id", r6("recent"))


@query
def recent_training_pit(spark, sf):
    out = history.recent_training(t.race_starts(spark, sf), t.training_log(spark, sf), 7)
    return out.select("event_id", r6("training"), "sessions")


# -- split and preprocessing -----------------------------------------------


@query
def time_split(spark, sf):
    rows = split.time_split(t.dated_runners(spark, sf).select("race_id", "race_date"))
    return rows.groupBy("split", "race_date").agg(F.count(F.lit(1)).alias("entries")).select(
        "split", day(), "entries"
    )


@query
def dataset_profile(spark, sf):
    return metrics.profile(t.dated_entries(spark, sf).select(*t.KEYS, "race_date", "hrNo", "odds", "win")).select(
        "entries", "races", "columns", day("first_date"), day("last_date")
    )


def _with_gaps(spark, sf):
    """Dated runners with the split, and tax missing wherever the gate is 3.

    Stored, as fitting passes over it several times."""
    rows = split.time_split(t.dated_runners(spark, sf))
    gaps = rows.withColumn("tax", F.when(F.col("gate") != 3, F.col("tax")))
    return lay_down(gaps.select(*t.KEYS, "split", "tax", "qty", "discount"), "split")


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


@query
def impute_median(spark, sf):
    rows = _with_gaps(spark, sf)
    out = preprocess.impute(_train(rows), rows, ["tax"])
    return out.select(*t.KEYS, r6("tax"), F.col("tax_missing").cast("bigint").alias("tax_missing"))


@query
def winsorize(spark, sf):
    rows = _with_gaps(spark, sf).withColumn("raw", F.col("price"))
    out = preprocess.winsorize(_train(rows), rows, ["price", "qty"])
    return out.select("race_id", "raw", r6("price", "clipped_price"), r6("qty", "clipped_qty"))


@query
def standardize(spark, sf):
    rows = _with_gaps(spark, sf)
    out = preprocess.standardize(_train(rows), rows, ["qty", "discount"])
    return out.select(*t.KEYS, r6("qty", "z_qty"), r6("discount", "z_discount"))


@query
def version_v1_base(spark, sf):
    out = preprocess.build_version(_with_gaps(spark, sf), "v1_base", ["tax", "qty"])
    return out.select(
        *t.KEYS, "split", r6("tax"), r6("qty"), F.col("tax_missing").cast("bigint").alias("tax_missing")
    )


@query
def version_v2_standard(spark, sf):
    out = preprocess.build_version(_with_gaps(spark, sf), "v2_standard", ["tax", "qty"])
    return out.select(*t.KEYS, "split", r6("tax"), r6("qty"))


NUMERIC = ("price", "qty", "discount", "tax")


def _numeric(spark, sf):
    return t.runners(spark, sf).select(*NUMERIC)


@query
def correlation_pairs(spark, sf):
    return preprocess.correlation_pairs(_numeric(spark, sf), NUMERIC).select(
        "col_a", "col_b", r6("r")
    )


def _collinear(spark, sf):
    """Price, price after discount (nearly the same thing) and quantity."""
    return t.runners(spark, sf).select(
        "price", (F.col("price") * (1 - F.col("discount"))).alias("net"), "qty"
    )


@query
def vif(spark, sf):
    return preprocess.vif(_collinear(spark, sf), ["price", "net", "qty"]).select(
        "feature", F.round("vif", 4).alias("vif")
    )


@query
def drop_collinear(spark, sf):
    kept = preprocess.drop_collinear(_collinear(spark, sf), ["price", "net", "qty"], 5.0)
    means = _collinear(spark, sf).agg(*[F.avg(c).alias(c) for c in kept])
    return metrics.metric_rows(means, "kept").select(
        F.col("metric").alias("feature"), F.round("value", 4).alias("mean")
    )


# -- projections, venues, entities -----------------------------------------


@query
def venue_entries(spark, sf):
    return select.filter_venue(t.venue_entries(spark, sf, "ASIA"), "ASIA").select(*t.KEYS, "venue", day())


@query
def union_venues(spark, sf):
    asia = t.venue_entries(spark, sf, "ASIA").select(*t.KEYS, "venue", "tax")
    europe = t.venue_entries(spark, sf, "EUROPE").select(*t.KEYS, "venue", "discount")
    return select.union_venues(asia, europe)


@query
def period_entries(spark, sf):
    rows = select.filter_period(t.dated_runners(spark, sf), "1997-01-01", "1999-12-31")
    return rows.select(*t.KEYS, day())


@query
def join_entity(spark, sf):
    jockeys = t.table(spark, sf, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("jkNo"),
        F.col("s_name").alias("jockey"),
    )
    return joins.join_entity(t.runners(spark, sf), jockeys, "jkNo").select(*t.KEYS, "jkNo", "jockey")


@query
def leak_free_features(spark, sf):
    rows = t.entries(spark, sf)
    kept = select.drop_market(select.drop_post_race(rows, t.ROLES), t.ROLES)
    kept = select.project_model_columns(kept, [c for c in kept.columns if t.ROLES[c] == "feature"])
    return kept.select(
        *[F.col(c).cast("bigint" if c in ("gate", "runners") else "double").alias(c) for c in kept.columns]
    )


SELECTABLE = ("gate", "discount", "tax", "runners")


@query
def feature_subset(spark, sf):
    scores = strategy.feature_correlation(t.entries(spark, sf), SELECTABLE, "win")
    return select.top_features(scores, 2).select("feature", r6("score"))


# -- calibration -----------------------------------------------------------


@query
def temperature(spark, sf):
    warm = t.priced(spark, sf, lambda df, hot: race.adjust_temperature(df, "p", 2.0, hot=hot))
    return warm.select(*t.KEYS, r6("p_t"))


def _small_blend(df: DataFrame, hot) -> DataFrame:
    return race.blend(df, "market", "model", 0.1, hot=hot)


@query
def blend(spark, sf):
    return t.modelled(spark, sf, _small_blend).select(*t.KEYS, r6("p_blend"))


@query
def race_normalize(spark, sf):
    return t.modelled(spark, sf).select(*t.KEYS, r9("model"))


@query
def race_softmax(spark, sf):
    rows = t.runners(spark, sf).withColumn("s", F.col("qty") / 10)
    return race.race_softmax(rows, "s", hot=t.hot_races(spark, sf)).select(*t.KEYS, r6("p"))


@query
def calibration_grid(spark, sf):
    return calibration.calibration_grid(t.modelled(spark, sf), WEIGHTS, TEMPERATURES).select(
        "w", "t", r6("log_loss")
    )


@query
def parameter_grid(spark, sf):
    """The blend itself at every grid point, averaged over the entries."""
    rows = joins.grid(t.modelled(spark, sf).select("market", "model"), WEIGHTS, TEMPERATURES)
    mixed = (1 - F.col("w")) * F.col("market") + F.col("w") * F.col("model")
    return rows.groupBy("w", "t").agg(
        F.count(F.lit(1)).alias("entries"), F.round(F.avg(F.pow(mixed, 1 / F.col("t"))), 6).alias("mean")
    )


@query
def calibrated_holdout(spark, sf):
    """Weight and temperature picked on valid, scored on test."""
    cuts = split.split_cuts(t.dated_runners(spark, sf).select("race_date"))
    rows = t.modelled(spark, sf).select(*t.KEYS, "race_date", "market", "model", "win")
    labelled = lay_down(split.label_split(rows, cuts), "modelled")
    choice = calibration.calibrate(labelled.where(F.col("split") == "valid"), WEIGHTS, TEMPERATURES)
    test = labelled.where(F.col("split") == "test")
    tested = calibration.calibration_grid(test, [choice.weight], [choice.temperature])
    return tested.select(
        "w", "t", F.round(F.lit(choice.loss), 6).alias("valid_loss"), r6("log_loss", "test_loss")
    )


# -- uncertainty -----------------------------------------------------------


def _calibrated(spark, sf):
    """Modelled entries with the registered blend as ``p``."""
    return t.modelled(
        spark, sf, lambda df, hot: calibration.apply_calibration(df, BLEND, hot=hot)
    )


@query
def paired_gain(spark, sf):
    gains = bootstrap.gains_in(_calibrated(spark, sf), "market", "p")
    return bootstrap.paired_gain(gains).select(r6("gain"), "races")


@query
def paired_join(spark, sf):
    """The same gain from two loss tables that were made separately."""
    market = metrics.race_losses(t.priced(spark, sf), "p")
    blended = metrics.race_losses(_calibrated(spark, sf), "p")
    return bootstrap.paired_losses(market, blended).select("race_id", r6("gain"))


@query
def bootstrap_ci(spark, sf):
    gains = bootstrap.gains_in(_calibrated(spark, sf), "market", "p")
    return bootstrap.gain_ci(gains, count=settings.REPLICATES).select(r6("value"), r6("lo"), r6("hi"))


def _chosen(spark, sf):
    return strategy.select_bets(_scored(spark, sf), "score", t.KEYS)


@query
def prob_profit(spark, sf):
    return bootstrap.prob_profit(_chosen(spark, sf)).select(
        r6("profitable"), r6("mean_roi"), "replicates"
    )


@query
def roi_ci(spark, sf):
    return bootstrap.roi_ci(_chosen(spark, sf), count=settings.REPLICATES).select(
        r6("value"), r6("lo"), r6("hi")
    )


@query
def lift_ci(spark, sf):
    flagged = select.top_flag(_scored(spark, sf), "score", t.KEYS, name="chosen")
    return bootstrap.lift_ci(flagged, "chosen", count=settings.REPLICATES).select(
        r6("value"), r6("lo"), r6("hi")
    )


# -- strategy --------------------------------------------------------------


@query
def odds_band_roi(spark, sf):
    return metrics.roi(select.odds_band(t.entries(spark, sf))).select("bets", r6("roi"))


@query
def roi_by_band(spark, sf):
    out = metrics.roi_by_band(t.entries(spark, sf), BANDS, with_total=True)
    return out.select(F.coalesce("band", F.lit(-1)).alias("band"), "bets", "hits", r6("roi"))


@query
def select_bets(spark, sf):
    return _chosen(spark, sf).select(*t.KEYS, r6("odds"), F.col("win").cast("bigint").alias("win"))


@query
def expected_return(spark, sf):
    out = metrics.with_expected_return(t.modelled(spark, sf), "model")
    return out.select(*t.KEYS, r6("expected_return"))


@query
def positive_return(spark, sf):
    return select.positive_return(t.modelled(spark, sf), "model").select(*t.KEYS, r6("odds"))


@query
def bet_gate(spark, sf):
    rows = t.modelled(spark, sf)
    gates = [
        strategy.bet_gate(rows, p).withColumn("probability", F.lit(p)) for p in ("market", "model")
    ]
    return gates[0].unionByName(gates[1]).select("probability", "candidates", r6("best"), "policy")


@query
def compare_strategies(spark, sf):
    odds, market, model = F.col("odds"), F.col("market"), F.col("model")
    rules = {
        "all": F.lit(True),
        "odds_band": odds.between(*settings.ODDS_BAND),
        "favourites": odds < 3,
        "long_shots": odds > 50,
        "model_above_market": model > market,
        "small_fields": F.col("runners") <= 4,
    }
    table = t.modelled(spark, sf).withColumn("score", ranked_score("model"))
    table = lay_down(table.select(*t.KEYS, "odds", "win", "market", "model", "runners", "score"), "strategies")
    rows = strategy.compare_strategies(table, rules)
    best = strategy.strategy_row(strategy.select_bets(table, "score", t.KEYS), "band_then_top")
    return rows.unionByName(best).select("strategy", "bets", r6("roi"))


@query
def allocate(spark, sf):
    out = strategy.allocate(t.modelled(spark, sf), 0.05, "model")
    return out.select(*t.KEYS, r6("stake"))


# -- upsets ----------------------------------------------------------------


@query
def upset_label(spark, sf):
    rows = strategy.upset_label(t.entries(spark, sf))
    return rows.select(*t.KEYS, F.col("upset").cast("bigint").alias("upset"))


def _typed_upsets(spark, sf):
    rows = strategy.upset_type(strategy.upset_label(t.with_form(spark, sf)))
    won = rows.where(F.col("upset") == 1)
    return lay_down(won.select("type", "odds", "rest_days", "prior_starts"), "upsets")


@query
def upset_type_profile(spark, sf):
    cols = ["odds", "rest_days", "prior_starts"]
    out = strategy.profile_by_type(_typed_upsets(spark, sf), cols)
    return out.select(
        "type", "n", *[r6(f"{kind}_{c}") for kind in ("mean", "median") for c in cols]
    )


@query
def feature_effect(spark, sf):
    rows = strategy.upset_label(t.entries(spark, sf))
    out = strategy.feature_effect(rows, ["price", "discount", "tax"], "upset")
    return out.select("feature", "bin", "n", r6("rate"))


@query
def feature_correlation(spark, sf):
    rows = strategy.upset_label(t.entries(spark, sf))
    return strategy.feature_correlation(rows, [*SELECTABLE, "price"], "upset").select(
        "feature", r6("score")
    )


# -- comparisons -----------------------------------------------------------


@query
def market_gap(spark, sf):
    rows = t.modelled(spark, sf).select(*t.KEYS, "win", "model", "market")
    out = metrics.market_gap(lay_down(rows, "scored"), "model", "market", ["price"])
    return out.select(*[r6(c) for c in out.columns])


@query
def entry_gap(spark, sf):
    return metrics.entry_gap(t.modelled(spark, sf), "model", "market").select(*t.KEYS, r6("gap"))


def _numbered(rows: DataFrame, hot) -> DataFrame:
    """Entries with their place in the race. Prices repeat within races of larger tables;
    entries that also agree in ``qty`` and ``hrNo`` have one market, model and win."""
    return with_group_rank(rows, "race_id", [F.col("price"), F.col("qty"), F.col("hrNo")], "place", hot)


@query
def align(spark, sf):
    hot = t.hot_races(spark, sf)
    key = ["race_id", "place"]
    dated = t.dated_entries(spark, sf)
    parts = (
        t.modelled(spark, sf, _numbered).select(*key, "price", "model"),
        _numbered(race.market_prob(dated, hot=hot), hot).select(*key, F.col("p").alias("market")),
        _numbered(dated, hot).select(*key, "win"),
    )
    return joins.align(*parts, key).select(
        *t.KEYS, r9("model"), r6("market"), F.col("win").cast("bigint").alias("win")
    )


@query
def leaderboard(spark, sf):
    rows = t.modelled(spark, sf, _small_blend)
    rows = lay_down(rows.select(*t.KEYS, "win", "market", "model", "p_blend"), "scored")
    parts = [
        models.evaluate(rows, name, ["price"], col)
        for name, col in (("market", "market"), ("model", "model"), ("blend", "p_blend"))
    ]
    board = metrics.leaderboard(parts, ["auc", "log_loss", "top1_rate"])
    return board.select("model", r6("auc"), r6("log_loss"), r6("top1_rate"))


@query
def kfold(spark, sf):
    rows = split.kfold(t.runners(spark, sf).select("race_id"))
    per_race = rows.groupBy("race_id", "fold").agg(F.count(F.lit(1)).alias("n"))
    return per_race.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(
        F.count(F.lit(1)).alias("races"), F.sum("n").alias("entries")
    )


# -- models: no SQL counterpart --------------------------------------------


def _model_table(spark, sf):
    """Features with split and labels, laid down once a query: training reads them many times."""
    cuts = split.split_cuts(t.dated_runners(spark, sf).select("race_date"))
    rows = split.label_split(t.features(spark, sf), cuts)
    rows = strategy.upset_label(rows)
    cols = [*t.KEYS, "race_date", "split", "win", "upset", *t.FORM_FEATURES, *t.MARKET_FEATURES]
    rows = select.with_roles(rows.select(*cols), {c: t.FEATURE_ROLES[c] for c in cols if c in t.FEATURE_ROLES})
    return lay_down(rows, "features")


def _parts(spark, sf, rows=None):
    rows = _model_table(spark, sf) if rows is None else rows
    train = split.record_base_rate(_train(rows))
    return train, rows.where(F.col("split") == "test")


def _fitted(spark, sf, learner, label="win", allow_market=False, rows=None):
    """A fitted model, its features, and its stored test predictions."""
    train, test = _parts(spark, sf, rows)
    features = [*t.FORM_FEATURES, *(t.MARKET_FEATURES if allow_market else ())]
    model = models.fit(train, features, label, learner, allow_market=allow_market)
    return model, features, _predictions(models.score(model, test))


def _predictions(scored: DataFrame) -> DataFrame:
    return lay_down(scored.select(*t.KEYS, "win", "upset", "market", "p"), "predictions")


def _win_model(learner: str, name: str) -> Query:
    def run(spark, sf, rows=None):
        _, _, scored = _fitted(spark, sf, learner, rows=rows)
        return models.evaluate(scored, name, ["price"])

    run.__name__ = f"model_{name}"
    return query(run)


_win_model("random_forest", "rf")
_win_model("boosted_trees", "gbt")
_win_model("boosted_trees_wide", "gbt_wide")
_win_model("logistic", "logit")
_win_model("linear_svm", "svm")


@query
def model_two_stage(spark, sf, rows=None, whole=None):
    train, test = _parts(spark, sf, rows)
    scored = models.two_stage(train, test, list(t.FORM_FEATURES), whole=whole)
    return models.evaluate(_predictions(scored), "two_stage", ["price"])


@query
def model_nonmarket(spark, sf):
    """Features only, against the market on the same races."""
    _, _, scored = _fitted(spark, sf, "random_forest")
    return models.evaluate(scored, "features_only", ["price"]).unionByName(
        models.evaluate(scored, "market", ["price"], "market")
    )


def _upset_metrics(scored: DataFrame, name: str) -> DataFrame:
    auc = metrics.roc_auc(scored, "p", "upset").select("auc")
    lift = metrics.lift_at(scored, "p", t.KEYS, "upset").select("lift", "base_rate")
    return metrics.metric_rows(auc, name).unionByName(metrics.metric_rows(lift, name))


@query
def model_upset(spark, sf):
    return _upset_metrics(_fitted(spark, sf, "random_forest", "upset")[2], "upset")


@query
def model_upset_odds(spark, sf):
    return _upset_metrics(_fitted(spark, sf, "random_forest", "upset", True)[2], "upset_odds")


@query
def model_importances(spark, sf):
    """What drives upsets, by the tree model with odds."""
    model, features, _ = _fitted(spark, sf, "random_forest", "upset", True)
    return models.importances(model, features)


@query
def model_feature_count(spark, sf):
    """Whether more features help: AUC of the best two, five and all ten."""
    train, test = _parts(spark, sf)
    return models.feature_counts(train, test, t.FORM_FEATURES, (2, 5, len(t.FORM_FEATURES)))


@query
def model_comparison(spark, sf):
    """Six models side by side on the test split."""
    rows = _model_table(spark, sf)
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:

        def start(fn: Callable, *args):
            return pool.submit(inheritable_thread_target(spark)(fn), *args)

        # the forest starts first: the two-stage model waits for it, instead of fitting it again
        forest = start(lambda: _fitted(spark, sf, "random_forest", rows=rows))
        two_stage = start(model_two_stage, spark, sf, rows, lambda: forest.result()[0])
        others = [start(QUERIES[f"model_{r}"], spark, sf, rows) for r in ("gbt_wide", "gbt", "svm", "logit")]
        rf = models.evaluate(forest.result()[2], "rf", ["price"])
        parts = [rf, *(run.result() for run in (two_stage, *others))]
    return metrics.leaderboard(parts, ["auc", "log_loss", "top1_rate"])


@query
def compare_versions(spark, sf):
    """The two named dataset versions under logistic regression."""
    rows = _model_table(spark, sf)
    numeric = list(t.FORM_FEATURES)

    def evaluate(name: str, version: DataFrame) -> DataFrame:
        stored = lay_down(version, name)
        model = models.fit(_train(stored), numeric, "win", "logistic", t.FEATURE_ROLES)
        scored = models.score(model, stored.where(F.col("split") == "valid"))
        return models.evaluate(_predictions(scored), name, ["price"])

    return preprocess.compare_versions(rows, numeric, evaluate).orderBy("metric", "value")


@query
def cross_validation(spark, sf):
    train, _ = _parts(spark, sf)
    return models.cross_validate(train, list(t.FORM_FEATURES), "win", "boosted_trees")
