"""Market-probability calibration: blend weight and temperature."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions.odds import mix, neg_log, sharpen
from furlong.operators.race import share_in_race

# Grid points evaluated per pass; each adds two sums to one aggregation.
POINTS_PER_PASS = 24


class Choice(NamedTuple):
    weight: float
    temperature: float
    loss: float


def _race_losses(df: DataFrame, points, market, model, y, race) -> DataFrame:
    """Loss of every grid point for every race, from one aggregation per race.

    The race sum of the sharpened blend normalises the winner's share, so no
    probability has to be joined back to the entries.
    """
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_w")]
    for i, (w, t) in enumerate(points):
        s = sharpen(mix(market, model, w), t)
        aggs += [
            F.sum(s).alias(f"_all{i}"),
            F.sum(F.when(F.col(y) == 1, s)).alias(f"_won{i}"),
        ]
    per_race = df.groupBy(race).agg(*aggs).where((F.col("_n") >= 2) & (F.col("_w") == 1))
    return per_race.select(
        race,
        *[
            neg_log(F.try_divide(f"_won{i}", f"_all{i}")).alias(f"loss{i}")
            for i in range(len(points))
        ],
    )


def calibration_grid(
    df: DataFrame,
    weights: Iterable[float],
    temperatures: Iterable[float],
    market: str = "market",
    model: str = "model",
    y: str = "win",
    race: str = "race_id",
) -> DataFrame:
    """Race log loss of each (weight, temperature), one row per grid point.

    ``market`` and ``model`` are probabilities that sum to 1 in the race.
    """
    points = [(float(w), float(t)) for w in weights for t in temperatures]
    out = None
    for at in range(0, len(points), POINTS_PER_PASS):
        part = points[at : at + POINTS_PER_PASS]
        losses = _race_losses(df, part, market, model, y, race)
        wide = losses.agg(*[F.avg(f"loss{i}").alias(f"l{i}") for i in range(len(part))])
        rows = [
            F.struct(
                F.lit(w).alias("w"), F.lit(t).alias("t"), F.col(f"l{i}").alias("log_loss")
            )
            for i, (w, t) in enumerate(part)
        ]
        tall = wide.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
        out = tall if out is None else out.unionByName(tall)
    return out


def choose(grid: DataFrame) -> Choice:
    """The grid point with the smallest loss; ties go to the smaller weight, then T."""
    row = grid.where(F.col("log_loss").isNotNull()).orderBy("log_loss", "w", "t").first()
    if row is None:
        raise ValueError("no race to calibrate on")
    return Choice(row["w"], row["t"], row["log_loss"])


def calibrate(
    valid: DataFrame, weights: Iterable[float], temperatures: Iterable[float], **kw
) -> Choice:
    """Pick weight and temperature on the validation split."""
    return choose(calibration_grid(valid, weights, temperatures, **kw))


def apply_calibration(
    df: DataFrame,
    choice: Choice,
    market: str = "market",
    model: str = "model",
    name: str = "p",
    race: str = "race_id",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """The calibrated probability of every entry.

    Normalising the blend before the temperature would cancel out, so the race
    is summed once.
    """
    mixed = mix(market, model, choice.weight)
    return share_in_race(df, sharpen(mixed, choice.temperature), name, race, hot)
