"""What was known about a runner before the race.

History counts strictly earlier dates (D12). Starts are first combined to one
row per (runner, date), so a runner's window never holds more rows than there
are race dates, however many entries the runner has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.odds import days_between
from furlong.scale.skew import join_lookup, route


def start_days(
    entries: DataFrame,
    horse: str = "hrNo",
    date: str = "race_date",
    finish: str | None = "finish",
    parts: int | None = None,
    **sums: str,
) -> DataFrame:
    """One row per (runner, date): best finish, starts, and sums of named columns.

    With ``parts`` entries move once, by runner, into that many tasks, and windows by
    runner move nothing; leave it out where one runner has too many entries for a task.
    """
    if parts:
        entries = entries.repartition(parts, horse)
    aggs = [F.count(F.lit(1)).alias("starts")]
    if finish:
        aggs.append(F.min(finish).alias("result"))
    aggs += [F.sum(c).alias(name) for name, c in sums.items()]
    return entries.groupBy(horse, date).agg(*aggs)


def _earlier(horse: str, date: str):
    by_date = Window.partitionBy(horse).orderBy(date)
    return by_date, by_date.rowsBetween(Window.unboundedPreceding, -1)


def previous_result(
    days: DataFrame, horse: str = "hrNo", date: str = "race_date", name: str = "prev_result"
) -> DataFrame:
    by_date, _ = _earlier(horse, date)
    return days.withColumn(name, F.lag("result").over(by_date))


def rest_days(
    days: DataFrame, horse: str = "hrNo", date: str = "race_date", name: str = "rest_days"
) -> DataFrame:
    by_date, _ = _earlier(horse, date)
    return days.withColumn(name, days_between(date, F.lag(date).over(by_date)).cast("bigint"))


def prior_starts(
    days: DataFrame, horse: str = "hrNo", date: str = "race_date", name: str = "prior_starts"
) -> DataFrame:
    """Earlier dates with a start."""
    _, before = _earlier(horse, date)
    return days.withColumn(name, F.count(F.lit(1)).over(before))


def prior_mean(
    days: DataFrame,
    total: str,
    horse: str = "hrNo",
    date: str = "race_date",
    name: str = "prior_mean",
    default: float | None = None,
) -> DataFrame:
    """Mean over the starts of strictly earlier dates."""
    _, before = _earlier(horse, date)
    mean = F.sum(total).over(before) / F.sum("starts").over(before)
    if default is not None:
        mean = F.coalesce(mean, F.lit(float(default)))
    return days.withColumn(name, mean)


def attach_history(
    entries: DataFrame,
    days: DataFrame,
    cols: Sequence[str],
    horse: str = "hrNo",
    date: str = "race_date",
    hot: Sequence[int] | None = None,
    unique: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Give every entry the history row of its runner and date, in ``parts`` tasks where given.

    ``unique`` says that ``days`` is made by ``start_days``, whose keys cannot repeat."""
    return join_lookup(entries, days.select(horse, date, *cols), [horse, date], "left", hot, unique, parts)


def with_history(
    entries: DataFrame,
    horse: str = "hrNo",
    date: str = "race_date",
    finish: str | None = "finish",
    qty: str | None = None,
    name: str = "prior_qty",
    default: float | None = None,
    hot: Sequence[int] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Every entry with its runner's previous result, rest days and prior starts (given
    ``finish``) and mean of earlier starts ``name`` (given ``qty``), at its date.

    The rows of ordinary runners move once, into one window over their entries, in
    ``parts`` tasks where given. Those of ``hot`` runners are combined by date first, and
    the history is joined back.
    """
    cols = [*(("prev_result", "rest_days", "prior_starts") if finish else ()), *((name,) if qty else ())]

    def by_days(d: DataFrame) -> DataFrame:
        days = start_days(d, horse, date, finish, **({"_total": qty} if qty else {}))
        if finish:
            days = prior_starts(rest_days(previous_result(days, horse, date), horse, date), horse, date)
        if qty:
            days = prior_mean(days, "_total", horse, date, name, default)
        return attach_history(d, days, cols, horse, date, unique=True)

    def windowed(d: DataFrame) -> DataFrame:
        if parts:
            d = d.repartition(parts, horse)
        by_date = Window.partitionBy(horse).orderBy("_day")
        before = by_date.rangeBetween(Window.unboundedPreceding, -1)
        known = F.col(horse).isNotNull() & F.col(date).isNotNull()
        d = d.withColumn("_day", F.unix_date(F.col(date).cast("date")).cast("bigint"))
        found = {}
        if finish:
            # the latest earlier date and the best finish on it
            last = F.max(F.struct(F.col("_day"), (-F.col(finish)).alias("result"))).over(before)
            found["prev_result"] = -last["result"]
            found["rest_days"] = F.col("_day") - F.max("_day").over(before)
            found["prior_starts"] = F.dense_rank().over(by_date).cast("bigint") - 1
        if qty:
            mean = F.sum(qty).over(before) / F.count(F.lit(1)).over(before)
            found[name] = mean if default is None else F.coalesce(mean, F.lit(float(default)))
        return d.withColumns({c: F.when(known, v) for c, v in found.items()}).drop("_day")

    return route(entries, [horse], hot, windowed, by_days)


# -- rolling sums ----------------------------------------------------------


def micros(df: DataFrame, ts: str) -> Column:
    """A timestamp column as microseconds.

    Without a zone the wall-clock fields are counted, so the session zone and its
    clock changes play no part."""
    c = F.col(ts)
    if not isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def rolling_sum(
    df: DataFrame,
    span_us: int,
    sums: dict[str, str],
    key: str = "hrNo",
    ts: str = "ts",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Sums over the preceding ``span_us``, the current instant excluded.

    ``sums`` maps output names to summed columns; no row in the span gives null,
    and so does a missing key.
    """
    def sliced(d: DataFrame) -> DataFrame:
        return _rolling_by_slices(d, span_us, sums, key, ts)

    return route(
        df, [key], hot, lambda d: _rolling_in_blocks(d, span_us, sums, key, ts), sliced
    )


def _plus(a: Column, b: Column) -> Column:
    """Sum of two sums, null only where both are."""
    zero = F.lit(0.0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) + F.coalesce(b, zero))


def _rolling_in_blocks(
    df: DataFrame, span_us: int, sums: dict[str, str], key: str, ts: str
) -> DataFrame:
    """``rolling_sum`` in linear time with one shuffle.

    A sliding frame is summed anew for every row, which is quadratic for busy
    keys. Cut into blocks as long as the span, a row's span is the end of one
    block and the head of the next: two running sums. For the first, every row
    also leaves a mark where its span starts; the mark carries the sum from
    there to the end of its block back to the row.
    """
    own = df.withColumns({"_us": micros(df, ts), "_own": F.lit(True)})
    own = own.withColumn("_at", F.col("_us"))
    marks = own.select(
        key, "_us", F.lit(False).alias("_own"), (F.col("_us") - span_us).alias("_at")
    )
    both = (
        own.unionByName(marks, allowMissingColumns=True)
        .withColumn("_block", F.floor(F.col("_at") / F.lit(span_us)).cast("bigint"))
        .repartition(key)
    )
    block = Window.partitionBy(key, "_block")
    head = block.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    rest = block.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(key, "_us")
    mark = ~F.col("_own")
    summed = both.withColumns({f"_h_{n}": F.sum(c).over(head) for n, c in sums.items()})
    summed = summed.withColumns({f"_r_{n}": F.sum(c).over(rest) for n, c in sums.items()})
    summed = summed.withColumns(
        {f"_r_{n}": F.max(F.when(mark, F.col(f"_r_{n}"))).over(same) for n in sums}
    )
    known = F.col(key).isNotNull()
    return summed.where("_own").select(
        *df.columns,
        *[F.when(known, _plus(F.col(f"_h_{n}"), F.col(f"_r_{n}"))).alias(n) for n in sums],
    )


def _slices(span_us: int) -> int:
    """The largest count up to 1024 that cuts the span into equal whole slices."""
    return max(m for m in range(1, 1025) if span_us % m == 0)


def _rolling_by_slices(
    df: DataFrame, span_us: int, sums: dict[str, str], key: str, ts: str
) -> DataFrame:
    """``rolling_sum`` for keys too large for one task.

    Time is cut into slices, a whole number of which make the span. A row's sum
    is then: its own slice before it, the whole slices in between, and the end
    of the slice its span starts in. The first and last need only rows of one
    slice, the middle only slice totals, and no value is ever subtracted.
    """
    count = _slices(span_us)
    width = span_us // count
    names = list(sums)
    instants = (
        df.where(F.col(key).isNotNull())
        .withColumn("_us", micros(df, ts))
        .groupBy(key, "_us")
        .agg(*[F.sum(sums[n]).alias(n) for n in names])
    )
    slice_of = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    own = instants.select(key, "_us", F.col("_us").alias("_at"), F.lit(True).alias("_own"), *names)
    start = instants.select(
        key,
        "_us",
        (F.col("_us") - span_us).alias("_at"),
        F.lit(False).alias("_own"),
        *[F.lit(None).cast("double").alias(n) for n in names],
    )
    both = own.unionByName(start).withColumn("_slice", slice_of)
    up = Window.partitionBy(key, "_slice").orderBy("_at")
    down = Window.partitionBy(key, "_slice").orderBy(F.col("_at").desc())
    head = up.rangeBetween(Window.unboundedPreceding, -1)
    tail = down.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        both.withColumns(
            {
                f"_e_{n}": F.when(F.col("_own"), F.sum(n).over(head)).otherwise(F.sum(n).over(tail))
                for n in names
            }
        )
        .groupBy(key, "_us")
        .agg(*[F.sum(f"_e_{n}").alias(f"_e_{n}") for n in names])
        .withColumn("_slice", F.floor(F.col("_us") / F.lit(width)).cast("bigint"))
    )
    between = Window.partitionBy(key).orderBy("_slice").rangeBetween(1 - count, -1)
    middle = (
        instants.withColumn("_slice", F.floor(F.col("_us") / F.lit(width)).cast("bigint"))
        .groupBy(key, "_slice")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            key,
            "_slice",
            *[
                (F.sum(n).over(between) if count > 1 else F.lit(None).cast("double")).alias(f"_m_{n}")
                for n in names
            ],
        )
    )
    whole = edges.join(middle, [key, "_slice"], "left").select(
        key, "_us", *[_plus(F.col(f"_e_{n}"), F.col(f"_m_{n}")).alias(n) for n in names]
    )
    out = join_lookup(df.withColumn("_us", micros(df, ts)), whole, [key, "_us"], "left")
    return out.select(*df.columns, *names)


def recent_training(
    starts: DataFrame,
    log: DataFrame,
    days: float,
    amount: str = "amount",
    key: str = "hrNo",
    ts: str = "ts",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Training in the ``days`` before each start, strictly before it.

    The log is not joined to the starts: both go into one time-ordered window,
    where a start adds nothing, so the work stays linear in the rows.
    """
    span = math.floor(days * 86_400_000_000)
    cols = starts.columns
    logged = log.select(
        key, ts, F.col(amount).cast("double").alias("_amount"), F.lit(1.0).alias("_one"),
        F.lit(False).alias("_start"),
        *[F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in cols if c not in (key, ts)],
    )
    asked = starts.withColumns(
        {
            "_amount": F.lit(None).cast("double"),
            "_one": F.lit(None).cast("double"),
            "_start": F.lit(True),
        }
    )
    rolled = rolling_sum(
        logged.unionByName(asked), span, {"training": "_amount", "sessions": "_one"}, key, ts, hot
    )
    return rolled.where("_start").select(
        *cols,
        F.coalesce("training", F.lit(0.0)).alias("training"),
        F.coalesce("sessions", F.lit(0.0)).cast("bigint").alias("sessions"),
    )
