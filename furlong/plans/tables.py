"""

A surrogate: it exercises every operator and says nothing about racing.
An order is a race, a line item is a runner, and (race_id, price) is its key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import history
from furlong.operators.race import market_prob, race_normalize
from furlong.scale.ordering import with_group_rank
from furlong.scale.skew import ALL_HOT, hot_keys, join_lookup, split_plan, with_group_totals

KEYS = ("race_id", "price")

# Mean quantity stands in where a runner has no earlier start.
NO_HISTORY = 25.5

# Pool share paid out; makes every race's 1/odds sum to 1.25.
PAYOUT = 0.8

ROLES = {
    "race_id": "id",
    "hrNo": "id",
    "jkNo": "id",
    "race_date": "time",
    "gate": "feature",
    "discount": "feature",
    "tax": "feature",
    "price": "market",
    "odds": "market",
    "qty": "post_race",
    "shipdate": "post_race",
    "returnflag": "post_race",
    "linestatus": "post_race",
    "runners": "feature",
    "win": "label",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _padded(col: str, width: int) -> Column:
    return F.lpad(F.col(col).cast("string"), width, "0")


def runners(spark: SparkSession, sf: str) -> DataFrame:
    """One row per runner, straight from the scan."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("race_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        _padded("l_partkey", 7).alias("hrNo"),
        _padded("l_suppkey", 6).alias("jkNo"),
        F.col("l_linenumber").alias("gate"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("shipdate"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


def races(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("race_id"),
        F.to_date("o_orderdate").alias("race_date"),
        F.col("o_custkey").alias("custkey"),
    )


def hot_races(spark: SparkSession, sf: str) -> tuple[int, ...]:
    """Hot race keys, found on the bare key column of the scan."""
    return hot_keys(runners(spark, sf).select("race_id"), "race_id")


def _hot_runners(spark: SparkSession, sf: str, horse: str) -> tuple[int, ...]:
    """Hot runner keys, found on the bare key column of the scan."""
    return hot_keys(runners(spark, sf).select(horse), horse)


def _hot_starts(spark: SparkSession, sf: str, rows: DataFrame, horse: str) -> tuple[int, ...]:
    """Hot (runner, date) pairs. Without a hot runner there are none, and finding
    that out takes one scan of the bare key."""
    if not _hot_runners(spark, sf, horse):
        return ()
    return hot_keys(rows.select(horse, "race_date"), [horse, "race_date"])


# Rows of a task that windows by race or runner run in.
TASK_ROWS = 250_000
# Fewer rows than this do not make a task of their own.
LEAST_ROWS = 20_000


def parts(spark: SparkSession, sf: str) -> int:
    """Tasks for the table of runners: their number grows with it, their size does not."""
    rows = runners(spark, sf).count()
    spread = min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS)
    return max(2, spread, -(-rows // TASK_ROWS))


def _runner_parts(spark: SparkSession, sf: str, horse: str = "hrNo") -> int | None:
    """``parts`` where rows can be dealt by runner, None where a runner is hot."""
    return None if _hot_runners(spark, sf, horse) else parts(spark, sf)


def _with_pool(df: DataFrame, hot: Sequence[int]) -> DataFrame:
    """Odds, field size and winner from three aggregates of the race."""
    best = F.min(F.struct((-F.col("qty")).alias("q"), F.col("price").alias("p")))
    pooled = with_group_totals(
        df,
        "race_id",
        {"_pool": F.sum("price"), "runners": F.count(F.lit(1)), "_best": best},
        hot,
    )
    won = (F.col("_best.q") == -F.col("qty")) & (F.col("_best.p") == F.col("price"))
    return (
        pooled.withColumn("odds", F.lit(PAYOUT) * F.col("_pool") / F.col("price"))
        .withColumn("win", F.when(won, 1).otherwise(0))
        .drop("_pool", "_best")
    )


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Runners with odds, field size and winner."""
    return _with_pool(runners(spark, sf), hot_races(spark, sf))


def priced(
    spark: SparkSession,
    sf: str,
    then: Callable[[DataFrame, Sequence[int]], DataFrame] = lambda d, hot: d,
) -> DataFrame:
    """Entries with the market probability ``p`` and a further race-level step."""

    def market(d: DataFrame, h: Sequence[int]) -> DataFrame:
        return then(market_prob(_with_pool(d, h), hot=h), h)

    return split_plan(runners(spark, sf), "race_id", hot_races(spark, sf), market)


def dated_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with the race date.

    Joining the races first lets the race window reuse the join's shuffle.
    """
    return _with_pool(dated_runners(spark, sf), hot_races(spark, sf))


def dated_runners(spark: SparkSession, sf: str) -> DataFrame:
    days = races(spark, sf).select("race_id", "race_date")
    return join_lookup(
        runners(spark, sf), days, "race_id", "inner", hot_races(spark, sf), unique=True, parts=parts(spark, sf)
    )


def finishes(spark: SparkSession, sf: str) -> DataFrame:
    """Dated runners with their finishing position."""
    order = [F.col("qty").desc(), F.col("price").asc()]
    return with_group_rank(
        dated_runners(spark, sf), "race_id", order, "finish", hot_races(spark, sf)
    )


def form(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (runner, date) with previous result, rest days and prior starts."""
    days = history.start_days(finishes(spark, sf), parts=_runner_parts(spark, sf))
    return history.prior_starts(history.rest_days(history.previous_result(days)))


def with_form(spark: SparkSession, sf: str) -> DataFrame:
    """Dated entries with odds, winner and the runner's form at that date."""
    hot, n = hot_races(spark, sf), parts(spark, sf)
    rows = history.with_history(finishes(spark, sf), hot=_hot_runners(spark, sf, "hrNo"), parts=n)
    return split_plan(rows, "race_id", hot, lambda d, h: _with_pool(_by_race(d, h, n), h))


def _by_race(df: DataFrame, hot: Sequence[int], n: int) -> DataFrame:
    """Rows of ordinary races spread over ``n`` tasks; hot ones stay where they are."""
    return df if hot is ALL_HOT else df.repartition(n, "race_id")


def modelled(
    spark: SparkSession,
    sf: str,
    then: Callable[[DataFrame, Sequence[int]], DataFrame] = lambda d, hot: d,
) -> DataFrame:
    """Dated entries with market probability and the deterministic model score.

    The score is the runner's mean quantity over earlier dates, as a share of
    its race's sum. Market, score and a further race-level step ``then`` share
    one grouping by race.
    """
    hot, n = hot_races(spark, sf), parts(spark, sf)
    rows = dated_runners(spark, sf)
    days = history.prior_mean(
        history.start_days(rows, finish=None, parts=_runner_parts(spark, sf), qty_sum="qty"),
        "qty_sum",
        name="prior_qty",
        default=NO_HISTORY,
    )
    with_form = history.attach_history(
        rows, days, ["prior_qty"], hot=_hot_starts(spark, sf, rows, "hrNo"), unique=True, parts=n
    )

    def probabilities(d: DataFrame, h: Sequence[int]) -> DataFrame:
        priced = market_prob(_with_pool(_by_race(d, h, n), h), name="market", hot=h)
        return then(race_normalize(priced, "prior_qty", "model", hot=h), h)

    return split_plan(with_form, "race_id", hot, probabilities)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with every leak-free feature the models use."""
    hot, n = hot_races(spark, sf), parts(spark, sf)
    rows = history.with_history(
        finishes(spark, sf), qty="qty", default=NO_HISTORY, hot=_hot_runners(spark, sf, "hrNo"), parts=n
    )
    rows = history.with_history(
        rows, "jkNo", finish=None, qty="qty", name="jockey_qty", default=NO_HISTORY,
        hot=_hot_runners(spark, sf, "jkNo"), parts=n,
    )
    filled = rows.withColumns(
        {
            "debut": F.col("prev_result").isNull().cast("int"),
            "prev_result": F.coalesce(F.col("prev_result"), F.lit(0)),
            "rest_days": F.coalesce(F.col("rest_days"), F.lit(0)),
        }
    )
    return split_plan(
        filled, "race_id", hot, lambda d, h: market_prob(_with_pool(_by_race(d, h, n), h), name="market", hot=h)
    )


FORM_FEATURES = (
    "gate", "discount", "tax", "runners", "prev_result", "rest_days", "prior_starts",
    "prior_qty", "jockey_qty", "debut",
)
MARKET_FEATURES = ("odds", "market")

FEATURE_ROLES = {
    **ROLES,
    **{f: "feature" for f in FORM_FEATURES},
    "market": "market",
    "finish": "post_race",
}


def venues(spark: SparkSession, sf: str, venue: str | None = None) -> DataFrame:
    """Venue name of every race, or of one venue's: region of the customer of the order."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_regionkey").alias("regionkey")
    )
    region = table(spark, sf, "region").select(
        F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("venue")
    )
    if venue is not None:
        region = region.where(F.col("venue") == venue)
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")
    )
    home = customer.join(nation, "nationkey").join(region, "regionkey").select("custkey", "venue")
    placed = join_lookup(races(spark, sf), home, "custkey", "inner")
    return placed.select("race_id", "race_date", "venue")


def venue_entries(spark: SparkSession, sf: str, venue: str | None = None) -> DataFrame:
    """Runners with date and venue, of all venues or of one."""
    return join_lookup(runners(spark, sf), venues(spark, sf, venue), "race_id", "inner", hot_races(spark, sf))


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training sessions: the click events of a user."""
    return _events(spark, sf).where(F.col("event_type") == "click").drop("event_type")


def race_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Race starts on the training log's time axis: the purchase events."""
    return _events(spark, sf).where(F.col("event_type") == "purchase").drop("event_type", "amount")


def all_training(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a training amount."""
    return _events(spark, sf).drop("event_type")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id"),
        F.lpad(F.col("user_id").cast("string"), 7, "0").alias("hrNo"),
        "ts",
        F.col("value").alias("amount"),
        "event_type",
    )
