"""Hot keys: finding them cheaply and giving their rows another plan.

A window or join on a key puts all rows of one key value in one task. That is
the best plan while groups are small, and fails when one key holds a large
share of the table. The functions here route only such keys to a second plan;
both plans give the same rows, so the routing never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A key is hot from this many rows on ...
MIN_ROWS = 5_000_000
# ... if it also holds this share of the table. The share bounds the number of
# hot keys (1 / share), and with it everything that is broadcast for them.
MIN_SHARE = 0.0005
# Counters of the frequent-items sketch: with these it cannot miss a key above
# MIN_SHARE (its error is 3.5 / 32768 of the rows).
TRACKED = 20_000
# Task sketches are merged in this many groups before the last merge.
MERGE_GROUPS = 256

_seen: dict[tuple, tuple[int, ...]] = {}


def _token(keys: Sequence[str]) -> Column:
    """One never-null bigint for a key of any type and width."""
    return F.xxhash64(*[F.col(k) for k in keys])


def min_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("furlong.skew.minRows", str(MIN_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str] | str) -> tuple[int, ...]:
    """Tokens of the hot values of ``keys``, at most ``1 / MIN_SHARE`` of them.

    One narrow scan: each task fills a fixed-size frequent-items sketch and only
    the sketches are merged, in two steps. The answer is remembered per plan; a stale one can
    cost time but not correctness.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = df.sparkSession
    floor = min_rows(spark)
    memo = (spark.sparkContext.applicationId, df.semanticHash(), tuple(keys), floor)
    if memo not in _seen:
        limit = int(1 / MIN_SHARE)
        group = F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))
        found = (
            df.select(_token(keys).alias("token"), group.alias("part"))
            .groupBy("part")
            .agg(
                F.expr(f"approx_top_k_accumulate(token, {TRACKED})").alias("sketch"),
                F.count(F.lit(1)).alias("n"),
            )
            .groupBy(F.lit("all"))  # unlike a plain agg, no row and no error on an empty table
            .agg(
                F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"),
                F.sum("n").alias("n"),
            )
            .select(F.expr(f"approx_top_k_estimate(sketch, {limit})").alias("top"), "n")
            .first()
        )
        hot = ()
        if found is not None:
            least = max(floor, MIN_SHARE * found["n"])
            hot = tuple(r["item"] for r in found["top"] if r["count"] >= least)
        if len(_seen) > 1000:
            _seen.clear()
        _seen[memo] = hot
    return _seen[memo]


def is_hot(keys: Sequence[str], hot: Sequence[int]) -> Column:
    return _token(keys).isin(list(hot))


class _AllHot(tuple):
    """Marks a table whose every row belongs to a hot key."""


ALL_HOT = _AllHot()


def split_plan(
    df: DataFrame,
    keys: Sequence[str] | str,
    hot: Sequence[int] | None,
    plan: Callable[[DataFrame, Sequence[int]], DataFrame],
) -> DataFrame:
    """Run ``plan(rows, hot)`` once for ordinary groups and once for hot ones.

    Steps inside ``plan`` are handed ``()`` or ``ALL_HOT``, so several of them on
    the same key split the table only once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if hot is None:
        hot = hot_keys(df, keys)
    if hot is ALL_HOT or not hot:
        return plan(df, hot)
    flag = is_hot(keys, hot)
    return plan(df.where(~flag), ()).unionByName(plan(df.where(flag), ALL_HOT))


def route(
    df: DataFrame,
    keys: Sequence[str] | str,
    hot: Sequence[int] | None,
    cold_plan: Callable[[DataFrame], DataFrame],
    hot_plan: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Apply ``cold_plan`` to ordinary groups and ``hot_plan`` to hot ones."""
    return split_plan(df, keys, hot, lambda d, h: hot_plan(d) if h is ALL_HOT else cold_plan(d))


def with_group_totals(
    df: DataFrame,
    keys: Sequence[str] | str,
    totals: dict[str, Column],
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Add per-group aggregates to every row of the group.

    Ordinary groups: one window, one shuffle. Hot groups: partial aggregation,
    then a broadcast of the few resulting rows, so their rows are not moved.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def windowed(d: DataFrame) -> DataFrame:
        frame = Window.partitionBy(*keys)
        return d.withColumns({name: agg.over(frame) for name, agg in totals.items()})

    def joined(d: DataFrame) -> DataFrame:
        small = d.groupBy(*[F.col(k).alias(f"{k}__g") for k in keys]).agg(
            *[agg.alias(name) for name, agg in totals.items()]
        )
        return null_safe_join(d, F.broadcast(small), keys, "inner")

    return route(df, keys, hot, windowed, joined)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, which the right side carries with the suffix ``__g``."""
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"{k}__g"))
        cond = eq if cond is None else cond & eq
    return left.join(right, cond, how).drop(*[f"{k}__g" for k in keys])


def once_per_key(lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``lookup`` with a whole key; reading a key that it repeats fails.

    The count is a window on the key, so a sort-merge join on that key shares its
    shuffle and its sort, and nothing runs before the join does. Filters on other
    columns do not pass the check: filter the lookup first.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    name = "_n"
    while name in lookup.columns:
        name += "_"
    single = F.when(F.col(name) == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"the lookup table repeats its key {list(keys)}")).cast("boolean")
    )
    return lookup.dropna("any", subset=list(keys)).withColumn(name, n).where(single).drop(name)


def join_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | str,
    how: str = "left",
    hot: Sequence[int] | None = None,
    unique: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Join ``left`` to a table with one row per key, in ``parts`` tasks where given.

    A lookup that repeats a key is refused when the result is computed, whether the key
    is hot or not. ``unique`` is for a primary key: nothing is checked, and filters on
    the lookup's other columns reach its scan. Spark picks broadcast or sort-merge for the bulk. Rows of a hot key
    meet a broadcast of the matching lookup rows, which are as few as there are hot keys.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"a lookup joins left or inner, not {how!r}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not unique:
        right = once_per_key(right, keys)
    if hot is None:
        hot = hot_keys(left, keys)

    def joined(rows: DataFrame) -> DataFrame:
        if parts is None:
            return rows.join(right, keys, how)
        return rows.repartition(parts, *keys).join(right.repartition(parts, *keys), keys, how)

    if not hot:
        return joined(left)
    few = right.where(is_hot(keys, hot))
    flag = is_hot(keys, hot)
    return joined(left.where(~flag)).unionByName(
        left.where(flag).join(F.broadcast(few), keys, how)
    )
