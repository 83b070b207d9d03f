"""Positions in a total order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.scale.skew import null_safe_join, route
from furlong.scale.storage import lay_down

# monotonically_increasing_id keeps the partition in the bits above these.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    Range-partitioned sort, numbered inside each partition as it streams out;
    the partition sizes (one row per partition) give the offsets. The numbered
    rows are laid down because range bounds come from a sample, and rows and
    sizes must see the same layout.
    """
    numbered = lay_down(
        df.orderBy(*order).withColumn("_serial", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_block", F.shiftright("_serial", _ROW_BITS))
    sizes = numbered.groupBy("_block").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    local = F.col("_serial").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + local)
        .drop("_serial", "_block", "_offset")
    )


def with_group_rank(
    df: DataFrame,
    keys: Sequence[str] | str,
    order: Sequence[Column],
    name: str,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row inside its group.

    A hot group is ranked through the global order instead: its rows are
    contiguous there, so the rank is the distance from the group's first row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def windowed(d: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return d.withColumn(name, F.row_number().over(w).cast("bigint"))

    def positioned(d: DataFrame) -> DataFrame:
        placed = with_position(d, [F.col(k) for k in keys] + list(order), "_position")
        first = placed.groupBy(*[F.col(k).alias(f"{k}__g") for k in keys]).agg(
            F.min("_position").alias("_first")
        )
        return (
            null_safe_join(placed, F.broadcast(first), keys, "inner")
            .withColumn(name, F.col("_position") - F.col("_first") + 1)
            .drop("_position", "_first")
        )

    return route(df, keys, hot, windowed, positioned)


def cut_row(df: DataFrame, order: Sequence[Column], k: int) -> dict | None:
    """The ``k``-th row (1-based) of ``df`` in the total order, as a dict."""
    if k <= 0:
        return None
    row = with_position(df, order, "_position").where(F.col("_position") == k - 1).first()
    if row is None:
        return None
    found = row.asDict()
    found.pop("_position")
    return found
