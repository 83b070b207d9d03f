"""Splits and the evaluation protocol."""

from __future__ import annotations

from datetime import date as Date
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong import settings


class Cuts(NamedTuple):
    """Last date of the train and of the valid split."""

    train: Date | None
    valid: Date | None


def split_cuts(
    df: DataFrame,
    date: str = "race_date",
    train: float = settings.TRAIN_SHARE,
    valid: float = settings.VALID_SHARE,
) -> Cuts:
    """Where a chronological split falls.

    Rows are counted per date first, so the running total covers only dates.
    """
    per_date = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    upto = Window.orderBy(date)
    running = per_date.select(
        date, F.sum("n").over(upto).alias("upto"), F.sum("n").over(total).alias("all")
    )

    def last(share: float) -> Column:
        return F.max(F.when(F.col("upto") <= F.lit(share) * F.col("all"), F.col(date)))

    row = running.agg(last(train).alias("train"), last(train + valid).alias("valid")).first()
    return Cuts(row["train"], row["valid"])


def label_split(df: DataFrame, cuts: Cuts, date: str = "race_date", name: str = "split") -> DataFrame:
    """Add train / valid / test by date; the cuts are literals, so filters reach the scan."""
    out = F.lit("test")
    if cuts.valid is not None:
        out = F.when(F.col(date) <= F.lit(cuts.valid), F.lit("valid")).otherwise(out)
    if cuts.train is not None:
        out = F.when(F.col(date) <= F.lit(cuts.train), F.lit("train")).otherwise(out)
    return df.withColumn(name, out)


def time_split(
    df: DataFrame,
    date: str = "race_date",
    train: float = settings.TRAIN_SHARE,
    valid: float = settings.VALID_SHARE,
) -> DataFrame:
    """Chronological split; a date belongs wholly to one split, nothing is shuffled."""
    return label_split(df, split_cuts(df, date, train, valid), date)


def fold_of(race: Column | str, folds: int = settings.FOLDS) -> Column:
    """Fold number from a hash of the race, so a race never straddles folds."""
    race = F.col(race) if isinstance(race, str) else race
    digest = F.conv(F.substring(F.md5(race.cast("string")), 1, 8), 16, 10).cast("bigint")
    return (digest % F.lit(folds)).cast("int")


def kfold(
    df: DataFrame, folds: int = settings.FOLDS, race: str = "race_id", name: str = "fold"
) -> DataFrame:
    return df.withColumn(name, fold_of(race, folds))


def assert_unweighted(estimator=None, train: DataFrame | None = None, source: DataFrame | None = None,
                      y: str = "win", tolerance: float = 1e-9) -> None:
    """Refuse class weights, and training sets whose base rate was changed."""
    if estimator is not None and estimator.hasParam("weightCol"):
        if estimator.isDefined("weightCol") and estimator.getOrDefault("weightCol"):
            raise ValueError("class weights distort the probabilities; unset weightCol")
    if train is not None and source is not None:
        a = train.agg(F.avg(y)).first()[0]
        b = source.agg(F.avg(y)).first()[0]
        if a is None or b is None or abs(a - b) > tolerance:
            raise ValueError(f"base rate {a} of the training set differs from {b} of its source")


_RATE, _ROWS = "furlong.base_rate", "furlong.rows"
# How many standard deviations a part may be off the base rate of the set it is from.
_RATE_SLACK = 5.0


def record_base_rate(df: DataFrame, y: str = "win", of: DataFrame | None = None) -> DataFrame:
    """``df`` whose label carries its base rate and number of rows, those of ``of`` where given.

    ``fit`` holds every training set that has the column against them.
    """
    rate, n = (df if of is None else of).agg(F.avg(y), F.count(y)).first()
    if not n:
        return df
    field = df.schema[y]
    return df.withMetadata(y, {**field.metadata, _RATE: float(rate), _ROWS: int(n)})


def check_base_rate(df: DataFrame) -> None:
    """Refuse a table whose recorded base rates it does not have: it was resampled.

    Parts of the recorded set may differ as random parts do; more rows than the set may not be.
    """
    labels = [f for f in df.schema if _RATE in f.metadata]
    if not labels:
        return
    seen = df.agg(*[e for f in labels for e in (F.avg(f.name), F.count(f.name))]).first()
    for i, f in enumerate(labels):
        rate, n = seen[2 * i : 2 * i + 2]
        base, rows = f.metadata[_RATE], f.metadata[_ROWS]
        if not n:
            continue
        left_out = max(0.0, 1 - n / rows)
        slack = _RATE_SLACK * (base * (1 - base) / n * left_out) ** 0.5 + 1e-9
        if n > rows or abs(rate - base) > slack:
            raise ValueError(
                f"{n} rows with a base rate of {rate} in {f.name}, but its source has {rows} rows and {base}: resampled"
            )


def score_once(
    ledger: str, holdout_id: str, model: str, holdout: DataFrame, evaluate
) -> DataFrame:
    """Evaluate ``model`` on a hold-out for the first and only time.

    The use is written to the ledger before the evaluation runs; a second call
    for the same hold-out and model is refused.
    """
    spark = holdout.sparkSession
    schema = "holdout_id string, model string"
    try:
        used = spark.read.schema(schema).parquet(ledger)
        again = used.where((F.col("holdout_id") == holdout_id) & (F.col("model") == model))
        taken = not again.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        taken = False
    if taken:
        raise PermissionError(f"hold-out {holdout_id} was already scored for {model}")
    spark.createDataFrame([(holdout_id, model)], schema).write.mode("append").parquet(ledger)
    return evaluate(holdout)
