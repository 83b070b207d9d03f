"""Odds, probabilities and returns as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong import settings


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inverse_odds(odds: Column | str) -> Column:
    """1 / odds, null where odds are not positive."""
    odds = _col(odds)
    return F.when(odds > 0, F.lit(1.0) / odds)


def neg_log(p: Column | str) -> Column:
    """-ln(p), with p kept off zero (D5); null stays null."""
    p = _col(p)
    return F.when(p.isNotNull(), -F.ln(F.greatest(p, F.lit(settings.PROB_FLOOR))))


def sharpen(p: Column | str, temperature: float) -> Column:
    """p ** (1/T), still to be normalised in the race (D3)."""
    return F.pow(_col(p), F.lit(1.0 / temperature))


def mix(market: Column | str, model: Column | str, weight: float) -> Column:
    """(1-w) * market + w * model."""
    return F.lit(1.0 - weight) * _col(market) + F.lit(float(weight)) * _col(model)


def log_pool(market: Column | str, model: Column | str, weight: float) -> Column:
    """market**(1-w) * model**w, the optional log-opinion pool of D4."""
    return F.pow(_col(market), F.lit(1.0 - weight)) * F.pow(_col(model), F.lit(float(weight)))


def expected_return(p: Column | str, odds: Column | str) -> Column:
    """p * odds - 1."""
    return _col(p) * _col(odds) - F.lit(1.0)


def kelly(p: Column | str, odds: Column | str, cap: float) -> Column:
    """Kelly fraction (p*o - 1) / (o - 1), clipped to [0, cap]."""
    edge = F.try_divide(expected_return(p, odds), _col(odds) - F.lit(1.0))
    return F.when(_col(odds) > 1, F.least(F.greatest(edge, F.lit(0.0)), F.lit(float(cap)))).otherwise(
        F.lit(0.0)
    )


def bucket(value: Column | str, edges: Sequence[float]) -> Column:
    """Index of the half-open bucket [edge[i-1], edge[i]) a value falls in."""
    value = _col(value)
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(value < F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return F.when(value.isNotNull(), out)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))
