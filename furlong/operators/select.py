"""Projections, filters and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import settings
from furlong.functions.odds import expected_return
from furlong.scale.ordering import cut_row
from furlong.scale.selection import order_statistics

# Roles a column can have; features are what remains when the others are dropped.
ROLES = ("id", "time", "feature", "market", "post_race", "label")


def columns_with(roles: Mapping[str, str], *wanted: str) -> list[str]:
    unknown = set(roles.values()) - set(ROLES)
    if unknown:
        raise ValueError(f"unknown column roles {sorted(unknown)}")
    return [c for c, r in roles.items() if r in wanted]


# Where a column's role is kept in its metadata; it outlives projections, joins and parquet files.
_ROLE = "furlong.role"


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """``df`` whose columns carry their roles; columns computed from others carry none."""
    columns_with(roles)
    return df.select(
        *[
            F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, _ROLE: roles[f.name]}) if f.name in roles else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def roles_of(df: DataFrame) -> dict[str, str]:
    """The roles that columns carry."""
    return {f.name: f.metadata[_ROLE] for f in df.schema if _ROLE in f.metadata}


def drop_post_race(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Drop results and everything else known only after the race."""
    return df.drop(*columns_with(roles, "post_race"))


def drop_market(df: DataFrame, roles: Mapping[str, str], allow_market: bool = False) -> DataFrame:
    """Drop the current race's odds and betting columns unless explicitly allowed."""
    return df if allow_market else df.drop(*columns_with(roles, "market"))


def project_model_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*cols)


def check_features(
    features: Sequence[str], roles: Mapping[str, str], allow_market: bool = False
) -> list[str]:
    """Refuse what is not known to be a feature or, where allowed, a market column.

    Columns without a role are refused: nobody said that they are known before the race.
    """
    usable = set(columns_with(roles, "feature", *(["market"] if allow_market else [])))
    refused = [f for f in features if f not in usable]
    if refused:
        raise ValueError(f"not usable as features: {refused}")
    return list(features)


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` features with the largest absolute score, one row per feature in."""
    return scores.orderBy(F.abs("score").desc(), "feature").limit(k)


def filter_venue(df: DataFrame, venue: str) -> DataFrame:
    return df.where(F.col("venue") == venue)


def filter_period(df: DataFrame, first: str, last: str, date: str = "race_date") -> DataFrame:
    """Dates from ``first`` to ``last``, both included."""
    return df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def odds_band(
    df: DataFrame,
    lo: float = settings.ODDS_BAND[0],
    hi: float = settings.ODDS_BAND[1],
    odds: str = "odds",
) -> DataFrame:
    """Odds inside the band, both ends included."""
    return df.where(F.col(odds).between(lo, hi))


def positive_return(df: DataFrame, p: str = "p", odds: str = "odds") -> DataFrame:
    return df.where(expected_return(p, odds) > 0)


def union_venues(*tables: DataFrame) -> DataFrame:
    """One entry table from per-venue tables whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def top_count(n: int, share: float) -> int:
    """ceil(share * n), not thrown off by the binary form of the share."""
    return -int(-round(share * n, 9) // 1)


def _cut(df: DataFrame, score: str, keys: Sequence[str], share: float) -> dict | None:
    """Score and keys of the last row that is still among the top ``share``.

    The score is selected, not sorted for. Only rows that tie at it are ordered, and
    only where some of them stay out.
    """
    ((n, found),) = order_statistics(df, [score], lambda n: [n - top_count(n, share)] if top_count(n, share) else [])
    if not found:
        return None
    (at,) = found.values()
    above, ties = df.where(F.col(score) >= F.lit(at)).agg(
        F.count(F.when(F.col(score) > F.lit(at), 1)), F.count(F.when(F.col(score) == F.lit(at), 1))
    ).first()
    left = top_count(n, share) - above
    if left == ties:
        return {score: at}
    tied = df.where(F.col(score) == F.lit(at)).select(*keys)
    return {score: at, **cut_row(tied, [F.col(c).asc() for c in keys], left)}


def _up_to(cut: dict, score: str, keys: Sequence[str]) -> Column:
    """At or before the cut by score descending, then keys ascending."""
    keep = F.lit(True)
    for c in reversed([c for c in keys if c in cut]):
        keep = (F.col(c) < F.lit(cut[c])) | ((F.col(c) == F.lit(cut[c])) & keep)
    at = F.lit(cut[score])
    return (F.col(score) > at) | ((F.col(score) == at) & keep)


def top_fraction(
    df: DataFrame, score: str, keys: Sequence[str], share: float = settings.TOP_SHARE
) -> DataFrame:
    """The best ``ceil(share * n)`` rows by score, ties by key ascending.

    The row at the cut becomes an ordinary filter on the full rows, which are not
    moved at all. ``df`` is read several times, so store it when it is expensive or its
    scores' last digits may change when they are computed again.
    """
    cut = _cut(df, score, keys, share)
    if cut is None:
        return df.where(F.lit(False))
    # the first condition is implied, but simple enough to reach a parquet scan
    return df.where(F.col(score) >= F.lit(cut[score])).where(_up_to(cut, score, keys))


def top_flag(
    df: DataFrame,
    score: str,
    keys: Sequence[str],
    share: float = settings.TOP_SHARE,
    name: str = "top",
) -> DataFrame:
    """All rows, with 1 for those ``top_fraction`` would keep and 0 for the others."""
    cut = _cut(df, score, keys, share)
    kept = F.lit(False) if cut is None else F.coalesce(_up_to(cut, score, keys), F.lit(False))
    return df.withColumn(name, kept.cast("int"))
