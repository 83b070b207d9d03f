"""Race-level bootstrap with weights that depend only on race and replicate.

Every race draws a Poisson(1) weight per replicate from an md5 digest (D10).
The draws need no shared random state, so tasks can be rerun anywhere and give
the same replicates. One digest serves four replicates. A race's weights are a
vector; a task sums vectors and moves one row per replicate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import settings
from furlong.operators.metrics import beside, race_table
from furlong.scale.storage import lay_down

DRAWS = 4
_SLAB = 256  # units whose weights are held at once


def poisson_limits() -> list[str]:
    """Poisson(1) distribution function in 32-bit hex: a draw counts the limits it reaches."""
    out, mass, cum, k = [], math.exp(-1.0), 0.0, 0
    while True:
        cum += mass
        limit = round(cum * 2**32)
        if limit >= 2**32:
            return out
        out.append(f"{limit:08x}")
        k += 1
        mass /= k


def _weighted_sums(names: Sequence[str], count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task code: the sums of all replicates over a task's units, as ``count`` rows.

    The digests of a slab of units and all blocks are computed side by side, as one call
    for each costs several times as much. Returned from a function so that Spark ships it
    whole: executors need numpy and pyarrow, but not this package.
    """
    blocks = math.ceil(count / DRAWS)
    limits = [int(x, 16) for x in poisson_limits()]
    slab, names = _SLAB, list(names)
    # md5's constants (RFC 1321)
    adds = [int(2**32 * abs(math.sin(i + 1))) for i in range(64)]
    turns = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    # blocks whose numbers have equally many digits
    spans = [(d, lo, min(10**d, blocks)) for d in range(1, 20) if (lo := 10 ** (d - 1) if d > 1 else 0) < blocks]

    def md5_words(words, shape):
        """The four words of each digest of a one-chunk message, whose words are numbers or arrays."""
        a, b, c, d = (np.full(shape, x, np.uint32) for x in start)
        f = np.empty(shape, np.uint32)
        for i in range(64):
            if i < 16:
                k = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                k = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                k = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                k = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += np.uint32(adds[i])
            if words[k] is not None:
                f += words[k]
            turn = turns[i // 16][i % 4]
            np.left_shift(f, np.uint32(turn), out=a)
            f >>= np.uint32(32 - turn)
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        return [x + np.uint32(s) for x, s in zip((a, b, c, d), start)]

    ends = {}

    def end_of(n, digits, lo, hi):
        """What follows a prefix of ``n`` bytes: block number, padding, length, as words."""
        if (n, digits) not in ends:
            text = np.zeros((hi - lo, 64), np.uint8)
            text[:, n : n + digits] = np.frombuffer(b"".join(str(x).encode() for x in range(lo, hi)), np.uint8).reshape(-1, digits)
            text[:, n + digits] = 0x80
            text[:, 56:] = np.frombuffer((8 * (n + digits)).to_bytes(8, "little"), np.uint8)
            ends[n, digits] = text.view("<u4")
        return ends[n, digits]

    def draws(prefixes):
        """(draw, prefix, block) of 32-bit draws: big-endian words of the digests."""
        out = np.empty((DRAWS, len(prefixes), blocks), np.uint32)
        lengths = np.array([len(x) for x in prefixes])
        for n in set(lengths.tolist()):
            rows = np.flatnonzero(lengths == n)
            if n + len(str(blocks)) > 55:  # more than one chunk
                for i in rows:
                    digests = b"".join([md5(prefixes[i] + str(x).encode()).digest() for x in range(blocks)])
                    out[:, i] = np.frombuffer(digests, ">u4").reshape(blocks, DRAWS).T
                continue
            text = np.zeros((len(rows), 64), np.uint8)
            text[:, :n] = np.frombuffer(b"".join([prefixes[i] for i in rows]), np.uint8).reshape(len(rows), n)
            heads = text.view("<u4")
            for digits, lo, hi in spans:
                tails = end_of(n, digits, lo, hi)
                words = []
                for k in range(16):
                    head, tail = heads[:, k, None], tails[None, :, k]
                    if not tail.any():
                        words.append(head if head.any() else None)
                    else:
                        words.append(head | tail if head.any() else tail)
                for j, x in enumerate(md5_words(words, (len(rows), hi - lo))):
                    out[j, rows, lo:hi] = x.byteswap()
        return out

    def run(batches):
        total, seen = np.zeros((DRAWS, len(names), blocks)), False
        for batch in batches:
            units = batch.column(0).to_pylist()
            values = [c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            for at in range(0, len(units), slab):
                seen = True
                drawn = draws([b"" if u is None else f"{u}:".encode() for u in units[at : at + slab]])
                weights, reached = np.zeros(drawn.shape, np.uint8), np.empty(drawn.shape, bool)
                for limit in limits:
                    np.greater_equal(drawn, np.uint32(limit), out=reached)
                    weights += reached.view(np.uint8)
                total += np.stack([v[at : at + slab] for v in values]) @ weights.astype(float)
        if seen:
            sums = total.transpose(1, 2, 0).reshape(len(names), -1)
            columns = [pa.array(np.arange(count)), *(pa.array(row[:count]) for row in sums)]
            yield pa.RecordBatch.from_arrays(columns, ["replicate", *names])

    return run


def replicates(
    per_unit: DataFrame, sums: Sequence[str], unit: str = "race_id", count: int = settings.REPLICATES
) -> DataFrame:
    """Weighted sums of ``sums`` per replicate, from one row per unit.

    Replicate ``b`` of a unit uses draw ``b % 4`` of the digest of
    ``"<unit>:<b // 4>"``. Units are not moved and make no rows: a task hands on
    ``count`` sums of each column.
    """
    rows = per_unit.select(F.col(unit).cast("string").alias("_unit"), *sums)
    schema = "replicate long, " + ", ".join(f"`{c}` double" for c in sums)
    drawn = rows.mapInArrow(_weighted_sums(sums, count), schema)
    return drawn.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap_ci(
    per_unit: DataFrame,
    sums: Sequence[str],
    stat: Column,
    unit: str = "race_id",
    count: int = settings.REPLICATES,
    interval: tuple[float, float] = settings.INTERVAL,
) -> DataFrame:
    """Point value and percentile interval of a ratio of sums.

    ``stat`` is an expression over the columns ``sums``; it is applied to the
    plain sums and to those of each replicate. The unit table is stored first,
    both are computed from it.
    """
    per_unit = lay_down(per_unit.select(unit, *sums), "units")
    point = per_unit.agg(*[F.sum(c).alias(c) for c in sums]).select(stat.alias("value"))
    spread = (
        replicates(per_unit, sums, unit, count)
        .select(stat.alias("stat"))
        .agg(
            F.percentile("stat", F.lit(interval[0])).alias("lo"),
            F.percentile("stat", F.lit(interval[1])).alias("hi"),
        )
    )
    return beside(point, spread)


# -- what the intervals are taken of ---------------------------------------


def paired_losses(a: DataFrame, b: DataFrame, race: str = "race_id") -> DataFrame:
    """Per-race gain of ``b`` over ``a`` from two per-race loss tables.

    Races either side leaves out are left out.
    """
    both = a.select(race, F.col("loss").alias("_a")).join(
        b.select(race, F.col("loss").alias("_b")), race
    )
    return _gains(both, "_a", "_b", race)


def gains_in(
    df: DataFrame, a: str, b: str, y: str = "win", race: str = "race_id"
) -> DataFrame:
    """Per-race gain of probability ``b`` over ``a`` when both are on the same
    entries: one aggregation, no join."""
    return _gains(race_table(df, [a, b], (), y, race), f"loss_{a}", f"loss_{b}", race)


def _gains(losses: DataFrame, a: str, b: str, race: str) -> DataFrame:
    gain = F.col(a) - F.col(b)
    return losses.where(gain.isNotNull()).select(race, gain.alias("gain"), F.lit(1.0).alias("one"))


def paired_gain(gains: DataFrame) -> DataFrame:
    return gains.agg(F.avg("gain").alias("gain"), F.count(F.lit(1)).alias("races"))


def gain_ci(
    gains: DataFrame, race: str = "race_id", count: int = settings.REPLICATES
) -> DataFrame:
    return bootstrap_ci(gains, ["gain", "one"], F.try_divide("gain", "one"), race, count)


def lift_ci(
    df: DataFrame,
    chosen: str,
    y: str = "win",
    race: str = "race_id",
    count: int = settings.REPLICATES,
) -> DataFrame:
    """Interval of the lift of the rows flagged ``chosen`` (0/1), races resampled."""
    per_race = df.groupBy(race).agg(
        F.sum(F.col(chosen) * F.col(y)).cast("double").alias("top_hits"),
        F.sum(chosen).cast("double").alias("top"),
        F.sum(y).cast("double").alias("hits"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    lift = F.try_divide(F.try_divide("top_hits", "top"), F.try_divide("hits", "n"))
    return bootstrap_ci(per_race, ["top_hits", "top", "hits", "n"], lift, race, count)


def _per_race_bets(bets: DataFrame, odds: str, y: str, race: str) -> DataFrame:
    return bets.groupBy(race).agg(
        F.sum(F.col(y) * F.col(odds)).alias("back"),
        F.count(F.lit(1)).cast("double").alias("stake"),
    )


def _roi() -> Column:
    return F.try_divide("back", "stake") - 1


def roi_ci(
    bets: DataFrame, odds: str = "odds", y: str = "win", race: str = "race_id",
    count: int = settings.REPLICATES,
) -> DataFrame:
    return bootstrap_ci(
        _per_race_bets(bets, odds, y, race), ["back", "stake"], _roi(), race, count
    )


def prob_profit(
    bets: DataFrame, odds: str = "odds", y: str = "win", race: str = "race_id",
    count: int = settings.REPLICATES,
) -> DataFrame:
    """Share of replicates whose ROI is positive."""
    per_race = _per_race_bets(bets, odds, y, race)
    return (
        replicates(per_race, ["back", "stake"], race, count)
        .select(_roi().alias("roi"))
        .where(F.col("roi").isNotNull())
        .agg(
            F.avg((F.col("roi") > 0).cast("double")).alias("profitable"),
            F.avg("roi").alias("mean_roi"),
            F.count(F.lit(1)).alias("replicates"),
        )
    )
