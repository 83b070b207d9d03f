"""Exact order statistics of many columns, from aggregations alone.

All columns share every pass: values travel as (column, value) rows that are combined
in the task that reads them. A mergeable sketch of each column gives cuts around the
wanted ranks, exact counts place the ranks between the cuts, and a gap that still holds
many different values is sketched again. What remains is counted value by value. No
column is sorted, and the plan of a pass grows with the number of columns only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A gap of at most this many values is counted value by value.
HELD = 100_000
# Marks a sketch gives, and what it is built with: its ranks are off by less than 1 / ACCURACY.
GRID = 512
ACCURACY = 10_000
# Columns of one pass: a task holds a sketch of each.
AT_ONCE = 120


@dataclass
class _Gap:
    """An open interval of a column and the wanted ranks inside it; no end means all values."""

    col: int
    lo: float | None
    hi: float | None
    below: int  # values up to the lower end
    inside: int
    ranks: list[int] = field(default_factory=list)


def _rows_in(tall: DataFrame, gaps: Sequence[_Gap], cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """(gap, v, cut) of the values inside gaps, once for each of a gap's cuts.

    The table of gaps is as long as columns times ranks, whatever the data.
    """
    spark = tall.sparkSession
    rows = [
        (g.col, i, g.lo, g.hi, cut) for i, g in enumerate(gaps) for cut in (cuts[i] if cuts is not None else (None,))
    ]
    table = spark.createDataFrame(rows, "c int, gap int, lo double, hi double, cut double")
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    return tall.join(F.broadcast(table), "c").where(inside).select("gap", "v", "cut")


def _sketch(tall: DataFrame, gaps: Sequence[_Gap]) -> dict[int, tuple[int, int, list[float]]]:
    """(values, about how many different, marks) of each gap that has values."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    found = _rows_in(tall, gaps).groupBy("gap").agg(
        F.count("v").alias("n"),
        F.approx_count_distinct("v").alias("distinct"),
        F.percentile_approx("v", grid, F.lit(ACCURACY)).alias("marks"),
    )
    return {r["gap"]: (r["n"], r["distinct"], r["marks"]) for r in found.collect()}


def _cuts(gap: _Gap, marks: Sequence[float]) -> list[float]:
    """Values of the gap just before and behind each wanted rank."""
    out = set()
    slack = GRID / ACCURACY
    for r in gap.ranks:
        at = (r - gap.below) * GRID / gap.inside
        out.add(marks[max(0, int(at - slack))])
        out.add(marks[min(GRID, int(at + slack) + 2)])
    return sorted(out)


def _narrow(tall: DataFrame, gaps: Sequence[_Gap], cuts: Sequence[Sequence[float]], found: dict) -> list[_Gap]:
    """The gaps between the cuts that hold ranks; ranks that fall on a cut are found."""
    counted = _rows_in(tall, gaps, cuts).groupBy("gap", "cut").agg(
        F.count(F.when(F.col("v") < F.col("cut"), 1)).alias("less"),
        F.count(F.when(F.col("v") == F.col("cut"), 1)).alias("same"),
    )
    less = {(r["gap"], r["cut"]): (r["less"], r["same"]) for r in counted.collect()}
    out = []
    for i, g in enumerate(gaps):
        ends = [less[i, c] for c in cuts[i]]
        starts = [g.below + n for n, _ in ends]
        parts: dict[int, _Gap] = {}
        for r in g.ranks:
            j = bisect_right(starts, r) - 1  # the last cut whose first value has this rank or a smaller one
            if j >= 0 and r < starts[j] + ends[j][1]:
                found[g.col, r] = cuts[i][j]
                continue
            if j not in parts:
                below = starts[j] + ends[j][1] if j >= 0 else g.below
                end = starts[j + 1] if j + 1 < len(starts) else g.below + g.inside
                parts[j] = _Gap(
                    g.col, cuts[i][j] if j >= 0 else g.lo, cuts[i][j + 1] if j + 1 < len(starts) else g.hi, below, end - below
                )
            parts[j].ranks.append(r)
        out += parts.values()
    return out


def _pick(tall: DataFrame, gaps: Sequence[_Gap], found: dict) -> None:
    """Count the values of the gaps one by one and read off the wanted ranks."""
    counted = _rows_in(tall, gaps).groupBy("gap", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("gap").orderBy("v"))
    asked = [(i, r - g.below, r) for i, g in enumerate(gaps) for r in g.ranks]
    asked = tall.sparkSession.createDataFrame(asked, "gap int, at long, rank long")
    hits = (
        counted.withColumn("upto", upto)
        .join(F.broadcast(asked), "gap")
        .where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
    )
    for r in hits.select("gap", "rank", "v").collect():
        found[gaps[r["gap"]].col, r["rank"]] = r["v"]


def order_statistics(
    df: DataFrame, cols: Sequence[str], wanted: Callable[[int], Iterable[int]], held: int = HELD
) -> list[tuple[int, dict[int, float]]]:
    """For each column the number of its values, and the values at the wanted ranks.

    Nulls and NaN are no values.
    ``wanted`` is told the number and gives 0-based ranks in ascending order of value.
    Two passes over ``df`` where columns have at most ``held`` different values, one
    or two more for each time that a gap has to be narrowed: store ``df`` first when
    it is expensive.
    """
    out: list[tuple[int, dict[int, float]]] = []
    for a in range(0, len(cols), AT_ONCE):
        out += _some(df, cols[a : a + AT_ONCE], wanted, held)
    return out


def _some(df: DataFrame, cols: Sequence[str], wanted: Callable, held: int) -> list[tuple[int, dict[int, float]]]:
    values = F.array(*[F.col(c).cast("double") for c in cols])
    tall = df.select(F.posexplode(values).alias("c", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    gaps = [_Gap(i, None, None, 0, 0) for i in range(len(cols))]
    seen = _sketch(tall, gaps)
    sizes = [seen[i][0] if i in seen else 0 for i in range(len(cols))]
    found: dict[tuple[int, int], float] = {}
    ready: list[_Gap] = []
    for i, g in enumerate(gaps):
        g.inside = sizes[i]
        g.ranks = sorted(set(wanted(sizes[i]))) if sizes[i] else []
    sketched = [(g, *seen[g.col][1:]) for g in gaps if g.ranks]
    while sketched:
        ready += [g for g, distinct, _ in sketched if distinct <= held]
        wide = [(g, marks) for g, distinct, marks in sketched if distinct > held]
        if not wide:
            break
        narrowed = _narrow(tall, [g for g, _ in wide], [_cuts(g, marks) for g, marks in wide], found)
        ready += [g for g in narrowed if g.inside <= held]
        left = [g for g in narrowed if g.inside > held]
        seen = _sketch(tall, left) if left else {}
        sketched = [(g, *seen[i][1:]) for i, g in enumerate(left)]
    if ready:
        _pick(tall, ready, found)
    return [(n, {r: v for (c, r), v in found.items() if c == i}) for i, n in enumerate(sizes)]
