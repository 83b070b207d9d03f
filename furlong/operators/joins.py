"""Joins on entity, entry and time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.scale.skew import join_lookup
from furlong.sources.schema import assert_string_ids


def join_entity(
    entries: DataFrame, entity: DataFrame, key: str, hot: Sequence[int] | None = None
) -> DataFrame:
    """Left join on a string identifier; one entity row per identifier."""
    assert_string_ids(entries, [key])
    assert_string_ids(entity, [key])
    return join_lookup(entries, entity, key, "left", hot)


def align(
    pred: DataFrame, market: DataFrame, outcome: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Model, market and outcome of the same entries, one row each.

    An entry that a side lacks, or has twice, fails the result when it is computed.
    The key is the whole entry, so a race with many runners spreads out; the check is
    a window on it, which shares the joins' shuffle.
    """
    keys = list(keys)
    sides = [t.withColumn(f"_side{i}", F.lit(True)) for i, t in enumerate((pred, market, outcome))]
    both = sides[0].join(sides[1], keys, "full").join(sides[2], keys, "full")
    whole = F.col("_side0").isNotNull() & F.col("_side1").isNotNull() & F.col("_side2").isNotNull()
    once = F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1
    refused = F.raise_error(F.lit("entries do not line up: a side lacks or repeats one")).cast("boolean")
    checked = both.withColumn("_lines_up", whole & once)
    return checked.where(F.when(F.col("_lines_up"), F.lit(True)).otherwise(refused)).drop(
        "_side0", "_side1", "_side2", "_lines_up"
    )


def _common(pred: DataFrame, market: DataFrame, outcome: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.join(market, list(keys)).join(outcome, list(keys))


def align_counts(
    pred: DataFrame, market: DataFrame, outcome: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Row counts before and after ``align``: equal when nothing was lost or doubled."""
    sides = {"pred": pred, "market": market, "outcome": outcome}
    sides["aligned"] = _common(pred, market, outcome, keys)
    counted = [
        t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
        for name, t in sides.items()
    ]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def assert_aligned(
    pred: DataFrame, market: DataFrame, outcome: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``align``, refused at once when rows were lost or doubled on the way."""
    counts = {r["side"]: r["n"] for r in align_counts(pred, market, outcome, keys).collect()}
    if len(set(counts.values())) != 1:
        raise ValueError(f"entries do not line up: {counts}")
    return align(pred, market, outcome, keys)


def grid(df: DataFrame, weights: Iterable[float], temperatures: Iterable[float]) -> DataFrame:
    """Every row once per (weight, temperature); the grid is a literal array, not a join."""
    points = [
        F.struct(F.lit(float(w)).alias("w"), F.lit(float(t)).alias("t"))
        for w in weights
        for t in temperatures
    ]
    return df.withColumn("_g", F.explode(F.array(*points))).select("*", "_g.w", "_g.t").drop("_g")
