"""Metrics of probabilities, scores and bets. Each returns a one-row DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong import settings
from furlong.functions.odds import bucket, expected_return, inverse_odds, neg_log
from furlong.operators.select import top_fraction


def base_rate(df: DataFrame, y: str = "win") -> DataFrame:
    return df.agg(F.avg(y).alias("base_rate"), F.count(F.lit(1)).alias("entries"))


def overround(df: DataFrame, odds: str = "odds", race: str = "race_id") -> DataFrame:
    """Sum of 1/odds per race; what exceeds 1 is the pool's take."""
    return df.groupBy(race).agg(F.sum(inverse_odds(odds)).alias("overround"))


def payout_rate(df: DataFrame, odds: str = "odds", race: str = "race_id") -> DataFrame:
    return overround(df, odds, race).agg(
        F.avg(F.try_divide(F.lit(1.0), F.col("overround"))).alias("payout_rate"),
        F.avg("overround").alias("mean_overround"),
        F.count(F.lit(1)).alias("races"),
    )


# -- ROC-AUC ---------------------------------------------------------------

_BLOCK = "lo double, pos double, neg double, pairs double"


def _pair_counter() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Positive-over-negative pairs inside one sorted partition, as one row.

    Returned from a function so that Spark ships it whole: executors need numpy
    and pyarrow, but not this package.
    """

    def count(batches):
        lo = None
        pos = neg = pairs = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            p = batch.column("pos").to_numpy(zero_copy_only=False).astype(float)
            n = batch.column("neg").to_numpy(zero_copy_only=False).astype(float)
            if lo is None:
                lo = batch.column("score")[0].as_py()
            below = neg + np.cumsum(n) - n
            pairs += float(np.sum(p * (below + n / 2)))
            pos += float(p.sum())
            neg += float(n.sum())
        if lo is not None:
            row = {"lo": [lo], "pos": [pos], "neg": [neg], "pairs": [pairs]}
            yield pa.RecordBatch.from_pydict(row)

    return count


def roc_auc(df: DataFrame, score: str, y: str = "win") -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney, tied scores count half) of rows with a score and a label.

    Equal scores are combined before the shuffle, the distinct scores are
    range-partitioned, every partition reports one row, and only those rows
    meet in one place.
    """
    label = F.col(y).cast("double")
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(label).alias("pos"), F.sum(1 - label).alias("neg"))
    )
    blocks = (
        per_score.repartitionByRange("score")
        .sortWithinPartitions("score")
        .mapInArrow(_pair_counter(), _BLOCK)
    )
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("neg_before", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    won = F.sum(F.col("pairs") + F.col("pos") * F.col("neg_before"))
    pairs = F.sum("pos") * F.sum("neg")
    return carried.agg(
        F.when(pairs > 0, won / pairs).alias("auc"),
        F.sum("pos").cast("bigint").alias("positives"),
        F.sum("neg").cast("bigint").alias("negatives"),
    )


# -- race-level metrics ----------------------------------------------------


def race_table(
    df: DataFrame,
    ps: Sequence[str],
    keys: Sequence[str] = (),
    y: str = "win",
    race: str = "race_id",
    normalize: bool = False,
) -> DataFrame:
    """Per race and probability: ``loss_<p>`` and, given ``keys``, ``hit_<p>``.

    One aggregation serves all probabilities. ``hit`` is the label of the runner
    with the largest probability, ties by key (D6). With ``normalize`` raw
    scores may be given: the winner's score is divided by the race sum here, so
    no window over the entries is needed. Races that D5 leaves out (fewer than
    two runners, or not exactly one winner) keep their row, with nulls.
    """
    counts = (F.count(F.lit(1)) >= 2) & (F.sum(y) == 1)
    aggs = []
    for p in ps:
        won = F.max(F.when(F.col(y) == 1, F.col(p)))
        aggs.append(
            F.when(counts, neg_log(F.try_divide(won, F.sum(p)) if normalize else won)).alias(f"loss_{p}")
        )
        if keys:
            best = F.when(F.col(p).isNotNull(), F.struct((-F.col(p)).alias("p"), *keys))
            aggs.append(F.when(counts, F.min_by(F.col(y), best)).alias(f"hit_{p}"))
    return df.groupBy(race).agg(*aggs)


def race_losses(df: DataFrame, p: str, y: str = "win", race: str = "race_id") -> DataFrame:
    """-ln p(winner) per race; null for races D5 leaves out."""
    return race_table(df, [p], (), y, race).withColumnRenamed(f"loss_{p}", "loss")


def race_log_loss(df: DataFrame, p: str, y: str = "win", race: str = "race_id") -> DataFrame:
    """Mean of -ln p(winner) over races with two or more runners and one winner."""
    return race_losses(df, p, y, race).agg(
        F.avg("loss").alias("log_loss"),
        F.count("loss").alias("races"),
        (F.count(F.lit(1)) - F.count("loss")).alias("excluded"),
    )


def top1_rate(
    df: DataFrame, p: str, keys: Sequence[str], y: str = "win", race: str = "race_id"
) -> DataFrame:
    """Share of races won by the runner with the largest probability.

    Counts the races the log loss counts (D5)."""
    hit = f"hit_{p}"
    return race_table(df, [p], keys, y, race).agg(
        F.avg(hit).alias("top1_rate"), F.count(hit).alias("races")
    )


# -- selection metrics -----------------------------------------------------


def lift_at(
    df: DataFrame,
    score: str,
    keys: Sequence[str],
    y: str = "win",
    share: float = settings.TOP_SHARE,
) -> DataFrame:
    """Hit rate of the best ``share`` of the whole set over the overall rate."""
    chosen = top_fraction(df.select(score, *keys, y), score, keys, share)
    top = chosen.agg(F.avg(y).alias("top_rate"), F.count(F.lit(1)).alias("k"))
    overall = df.agg(F.avg(y).alias("base_rate"))
    return beside(top, overall).withColumn("lift", F.try_divide("top_rate", "base_rate"))


def beside(*one_row: DataFrame) -> DataFrame:
    """One-row tables of orderable columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def roi(bets: DataFrame, odds: str = "odds", y: str = "win") -> DataFrame:
    """Return of one unit on each bet: odds on a win, else nothing."""
    return bets.agg(
        F.count(F.lit(1)).alias("bets"),
        (F.try_divide(F.sum(F.col(y) * F.col(odds)), F.count(F.lit(1))) - 1).alias("roi"),
    )


def roi_by_band(
    bets: DataFrame,
    edges: Sequence[float],
    odds: str = "odds",
    y: str = "win",
    with_total: bool = False,
) -> DataFrame:
    """ROI per odds band; with ``with_total`` also over all bands (band null)."""
    banded = bets.withColumn("band", bucket(odds, edges).cast("bigint"))
    grouped = banded.rollup("band") if with_total else banded.groupBy("band")
    return grouped.agg(
        F.count(F.lit(1)).alias("bets"),
        F.sum(y).cast("bigint").alias("hits"),
        (F.try_divide(F.sum(F.col(y) * F.col(odds)), F.count(F.lit(1))) - 1).alias("roi"),
    )


def with_expected_return(
    df: DataFrame, p: str = "p", odds: str = "odds", name: str = "expected_return"
) -> DataFrame:
    return df.withColumn(name, expected_return(p, odds))


def market_gap(
    df: DataFrame,
    model: str,
    market: str,
    keys: Sequence[str],
    y: str = "win",
    race: str = "race_id",
) -> DataFrame:
    """Model minus market: AUC, log loss and Top-1, each with both sides.

    Reads ``df`` three times: once per AUC and once for all race metrics.
    """
    sides = (("model", model), ("market", market))
    per_race = race_table(df, [model, market], keys, y, race).agg(
        *[F.avg(f"loss_{p}").alias(f"log_loss_{tag}") for tag, p in sides],
        *[F.avg(f"hit_{p}").alias(f"top1_{tag}") for tag, p in sides],
    )
    aucs = [roc_auc(df, p, y).select(F.col("auc").alias(f"auc_{tag}")) for tag, p in sides]
    out = beside(per_race, *aucs)
    for metric in ("auc", "log_loss", "top1"):
        out = out.withColumn(
            f"{metric}_gap", F.col(f"{metric}_model") - F.col(f"{metric}_market")
        )
    return out


def entry_gap(df: DataFrame, model: str, market: str, name: str = "gap") -> DataFrame:
    return df.withColumn(name, F.col(model) - F.col(market))


def profile(df: DataFrame, race: str = "race_id", date: str = "race_date") -> DataFrame:
    """Rows, races, columns and period of a dataset."""
    per_race = df.groupBy(race).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last")
    )
    return per_race.agg(
        F.sum("n").alias("entries"),
        F.count(F.lit(1)).alias("races"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )


# -- comparison tables -----------------------------------------------------


def metric_rows(df: DataFrame, model: str) -> DataFrame:
    """A one-row metric table as (model, metric, value) rows."""
    pairs = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in df.columns
    ]
    return df.select(F.lit(model).alias("model"), F.explode(F.array(*pairs)).alias("m")).select(
        "model", "m.metric", "m.value"
    )


def leaderboard(metrics: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric."""
    tall = reduce(DataFrame.unionByName, metrics)
    return tall.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))
