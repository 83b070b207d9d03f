"""Exact quantiles of many columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from furlong.scale.selection import HELD, order_statistics


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], held: int = HELD
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the values of each column, nulls and NaN left out.

    All columns and probabilities share the passes over ``df``, see
    ``order_statistics``; store ``df`` first when it is expensive.
    """

    def ranks(n: int) -> set[int]:
        return {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}

    out: dict[str, list[float | None]] = {}
    for c, (n, found) in zip(cols, order_statistics(df, cols, ranks, held), strict=True):
        out[c] = []
        for p in probs:
            at = p * (n - 1)
            low = math.floor(at)
            out[c].append(found[low] + (found[math.ceil(at)] - found[low]) * (at - low) if n else None)
    return out
