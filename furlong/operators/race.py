"""Per-race probabilities and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.odds import inverse_odds, log_pool, mix, sharpen
from furlong.scale.ordering import with_group_rank
from furlong.scale.skew import with_group_totals


def share_in_race(
    df: DataFrame,
    weight: Column,
    name: str,
    race: str = "race_id",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """``weight`` divided by its sum over the race; null where that sum is 0."""
    out = with_group_totals(df.withColumn("_weight", weight), race, {"_total": F.sum("_weight")}, hot)
    return out.withColumn(name, F.try_divide("_weight", "_total")).drop("_weight", "_total")


def market_prob(df: DataFrame, odds: str = "odds", name: str = "p", **kw) -> DataFrame:
    """The probability the pool implies: 1/odds, normalised in the race."""
    return share_in_race(df, inverse_odds(odds), name, **kw)


def race_normalize(df: DataFrame, score: str, name: str = "p", **kw) -> DataFrame:
    """Model scores as probabilities that sum to 1 in the race."""
    return share_in_race(df, F.col(score), name, **kw)


def race_softmax(
    df: DataFrame,
    score: str,
    name: str = "p",
    race: str = "race_id",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """exp(score) normalised in the race, shifted by the race maximum first."""
    top = with_group_totals(df, race, {"_top": F.max(score)}, hot)
    return share_in_race(top, F.exp(F.col(score) - F.col("_top")), name, race, hot).drop("_top")


def adjust_temperature(df: DataFrame, p: str, temperature: float, name: str = "p_t", **kw) -> DataFrame:
    """p ** (1/T), renormalised in the race (D3)."""
    return share_in_race(df, sharpen(p, temperature), name, **kw)


def blend(
    df: DataFrame,
    market: str,
    model: str,
    weight: float,
    name: str = "p_blend",
    geometric: bool = False,
    **kw,
) -> DataFrame:
    """A small model share in the market probability, renormalised.

    ``geometric`` takes the log-opinion pool instead of the linear mix."""
    combined = (log_pool if geometric else mix)(market, model, weight)
    return share_in_race(df, combined, name, **kw)


def race_rank(
    df: DataFrame,
    p: str,
    keys: Sequence[str],
    name: str = "rk",
    race: str = "race_id",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Rank by probability inside the race, ties by key ascending."""
    order = [F.col(p).desc(), *[F.col(k).asc() for k in keys]]
    return with_group_rank(df, race, order, name, hot)


def race_favourites(df: DataFrame, p: str, keys: Sequence[str], race: str = "race_id") -> DataFrame:
    """The best row of each race, by one partially aggregated minimum."""
    first = F.when(F.col(p).isNotNull(), F.struct((-F.col(p)).alias("_p"), *keys))
    rest = [c for c in df.columns if c not in (race, p, *keys)]
    best = df.groupBy(race).agg(F.min_by(F.struct(p, *keys, *rest), first).alias("_row"))
    return best.select(race, "_row.*").select(*df.columns)
