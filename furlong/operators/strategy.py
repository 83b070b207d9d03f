"""Bet selection, upsets and their profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import settings
from furlong.functions.odds import bucket, expected_return, kelly
from furlong.operators.metrics import roi
from furlong.operators.select import odds_band, top_fraction
from furlong.scale.quantiles import exact_quantiles


def bet_gate(df: DataFrame, p: str = "p", odds: str = "odds") -> DataFrame:
    """``no_bet`` when no entry has a positive expected return.

    One aggregation; the largest expected return is kept as evidence.
    """
    value = expected_return(p, odds)
    return df.agg(
        F.count(F.when(value > 0, 1)).alias("candidates"), F.max(value).alias("best")
    ).withColumn("policy", F.when(F.col("candidates") == 0, "no_bet").otherwise("bet"))


def select_bets(
    df: DataFrame,
    score: str,
    keys: Sequence[str],
    band: tuple[float, float] = settings.ODDS_BAND,
    share: float = settings.TOP_SHARE,
    odds: str = "odds",
) -> DataFrame:
    """Inside the odds band, the best ``share`` by model score; the band comes first."""
    return top_fraction(odds_band(df, *band, odds=odds), score, keys, share)


def compare_strategies(
    df: DataFrame, strategies: Mapping[str, Column], odds: str = "odds", y: str = "win"
) -> DataFrame:
    """Bets and ROI of strategies given as predicates, all from one pass."""
    aggs = []
    for i, rule in enumerate(strategies.values()):
        back = F.sum(F.when(rule, F.col(y) * F.col(odds)))
        n = F.count(F.when(rule, 1))
        aggs += [n.alias(f"n{i}"), F.when(n > 0, back / n - 1).alias(f"roi{i}")]
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("strategy"), F.col(f"n{i}").alias("bets"), F.col(f"roi{i}").alias("roi")
        )
        for i, name in enumerate(strategies)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def strategy_row(bets: DataFrame, name: str, odds: str = "odds", y: str = "win") -> DataFrame:
    """ROI row of a strategy that is not a plain predicate."""
    return roi(bets, odds, y).select(F.lit(name).alias("strategy"), "bets", "roi")


def allocate(
    bets: DataFrame, cap: float, p: str = "p", odds: str = "odds", name: str = "stake"
) -> DataFrame:
    """Kelly stake of each bet, between 0 and ``cap``."""
    return bets.withColumn(name, kelly(p, odds, cap))


# -- upsets ----------------------------------------------------------------


def upset_label(
    df: DataFrame,
    min_odds: float = settings.UPSET_ODDS,
    odds: str = "odds",
    y: str = "win",
    name: str = "upset",
) -> DataFrame:
    """1 for a win at long odds, else 0 (D11); null where label or odds leave it open."""
    upset = (F.col(y) == 1) & (F.col(odds) >= min_odds)
    return df.withColumn(name, F.when(upset, 1).when(~upset, 0))


# The upset types, in the order the rules are tried.
TYPES = ("debut", "veteran_return", "rookie", "other")


def upset_type(
    df: DataFrame, starts: str = "prior_starts", rest: str = "rest_days", name: str = "type"
) -> DataFrame:
    """Debut, returning veteran, rookie, or other."""
    veteran = (F.col(starts) >= settings.VETERAN_STARTS) & (
        F.col(rest) >= settings.VETERAN_REST_DAYS
    )
    kind = (
        F.when(F.col(starts) == 0, TYPES[0])
        .when(veteran, TYPES[1])
        .when(F.col(starts).between(1, settings.VETERAN_STARTS - 1), TYPES[2])
        .otherwise(TYPES[3])
    )
    return df.withColumn(name, kind)


def profile_by_type(
    df: DataFrame, cols: Sequence[str], kind: str = "type", kinds: Sequence[str] = TYPES
) -> DataFrame:
    """Count, means and exact medians per type.

    The types are few and one may hold most rows, so the medians come from the
    aggregation-only quantiles, with one column per (type, feature).
    """
    split = df.select(
        *[
            F.when(F.col(kind) == k, F.col(c)).alias(f"{c}__{i}")
            for i, k in enumerate(kinds)
            for c in cols
        ]
    )
    medians = exact_quantiles(split, split.columns, [0.5])
    grouped = df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols]
    )
    for c in cols:
        value = F.lit(None).cast("double")
        for i, k in enumerate(kinds):
            value = F.when(F.col(kind) == k, F.lit(medians[f"{c}__{i}"][0]).cast("double")).otherwise(value)
        grouped = grouped.withColumn(f"median_{c}", value)
    return grouped


# -- what drives a label ---------------------------------------------------


def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; null where one of them does not vary."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def feature_correlation(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """Correlation of each feature with the label, one row per feature, one pass."""
    wide = df.agg(*[_corr(F.col(c), F.col(y)).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in cols]
    return wide.select(F.explode(F.array(*rows)).alias("f")).select("f.*")


def feature_effect(df: DataFrame, cols: Sequence[str], y: str, bins: int = 5) -> DataFrame:
    """Positive rate per feature bin, bins cut at exact quantiles.

    All features share one pass; equal values always share a bin.
    """
    edges = exact_quantiles(df, cols, [i / bins for i in range(1, bins)])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                bucket(F.col(c).cast("double"), sorted({e for e in edges[c] if e is not None})).alias("bin"),
            )
            for c in cols
        ]
    )
    return (
        df.select(y, F.explode(rows).alias("b"))
        .where(F.col("b.bin").isNotNull())
        .groupBy(F.col("b.feature").alias("feature"), F.col("b.bin").cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    )
