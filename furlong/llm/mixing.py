"""Mixing sources to target weights by entropy balancing.

Each source has a word target. Among all document rates that meet it, entropy
balancing takes those closest to "every document once" in relative entropy:
``rate = min(cap, exp(lambda_source * size / unit))``. The multipliers solve a
convex dual whose gradient and curvature are sums over documents, so each
Newton iteration is one distributed aggregation, for all sources at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.scale.ordering import with_position
from furlong.scale.storage import lay_down

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
TOLERANCE = 1e-9
ITERATIONS = 60
# Rounds that fill a gap in the documents' order; later ones take large documents first,
# which ends after two rounds for each power of two.
ROUNDS_IN_ORDER = 6
_WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ASCII white space; null counts none."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), _WORDS, "w")
    return F.length(F.regexp_replace(words, "[^w]+", "")).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP
) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes. A target stops at ``cap`` times its source's size; what
    is above goes to the others by weight until none is above: each target is
    ``min(cap * size, level * weight)`` for one level, which is raised until the
    set of stopped sources stands still. Only sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = with_position(per, [F.col("source").asc_nulls_last()], "_position")
    placed = lay_down(
        placed.select(
            "source",
            "source_size",
            F.element_at(turn, (F.pmod("_position", F.lit(len(weights))) + 1).cast("int")).alias("_weight"),
        ),
        "mix-sources",
    )
    most = F.col("source_size") * F.lit(float(cap))
    whole, level, stopped = placed.agg(F.sum("source_size"), F.sum("_weight")).first(), 0.0, -1
    total = float(whole[0] or 0)
    held, open_weight, n = 0.0, whole[1] or 0.0, 0
    while n != stopped and open_weight:
        stopped, level = n, (total - held) / open_weight
        over = most < F.col("_weight") * level
        held, open_weight, n = placed.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)),
            F.count(F.when(over, 1)),
        ).first()
    return placed.select(
        "source", "source_size", F.least(most, F.col("_weight") * F.lit(level)).alias("target")
    )


def multipliers(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, lambda, unit): Newton's method on the dual of every source.

    Documents of one source and size share a rate, so the sums run over
    (source, size) with counts. A step that leaves the bracket of the root is
    replaced by its midpoint. A target of ``cap`` times the size, the most there
    is, takes an infinite multiplier; one of zero a negative infinite one.
    """
    spectrum = lay_down(
        sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-spectrum"
    )
    unit = spectrum.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit"))
    full = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - TOLERANCE))
    ends = F.when(full, F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf")))
    state = lay_down(
        targets.join(unit, targets["source"].eqNullSafe(unit["source"]))
        .select(targets["source"], "target", "unit", F.coalesce(ends, F.lit(0.0)).alias("lam"))
        .withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "done": F.col("lam") != 0.0}),
        "mix-dual",
    )
    for _ in range(ITERATIONS):
        if state.where("NOT done").isEmpty():
            break
        s = state.alias("s")
        x = F.col("size") / F.col("unit")
        rate = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
        got = F.col("n") * F.col("size") * F.least(F.lit(float(cap)), rate)
        slope = F.when(rate < cap, F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        sums = (
            spectrum.join(s, spectrum["source"].eqNullSafe(s["source"]))
            .where("NOT done")
            .groupBy(s["source"].alias("_source"))
            .agg(F.sum(got).alias("_got"), F.sum(slope).alias("_slope"))
        )
        short = F.col("target") - F.col("_got")
        lo = F.when(short > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(short < 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("_slope") > 0, F.col("lam") + short / F.col("_slope"))
        inside = (newton > F.col("lo2")) & (newton < F.col("hi2"))
        bounded = (F.col("lo2") > float("-inf")) & (F.col("hi2") < float("inf"))
        middle = F.when(bounded, (F.col("lo2") + F.col("hi2")) / 2).otherwise(
            F.col("lam") + F.when(short > 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * (1 + F.abs("lam"))
        )
        step = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle)
        near = F.abs(short) <= F.lit(TOLERANCE) * F.col("target")
        moved = (
            state.join(sums, state["source"].eqNullSafe(F.col("_source")), "left")
            .withColumns({"lo2": lo, "hi2": hi})
            .withColumns({"_near": F.col("done") | F.coalesce(near, F.lit(True))})
        )
        state = lay_down(
            moved.select(
                "source",
                "target",
                "unit",
                F.when(F.col("_near"), F.col("lam")).otherwise(step).alias("lam"),
                F.when(F.col("_near"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("_near"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
                F.col("_near").alias("done"),
            ),
            "mix-dual",
        )
    return state.select("source", F.col("lam").alias("lambda"), "unit")


def _fill(pool: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of ``pool`` that fit into each source's gap, and what is left of the gaps.

    ``pool`` has (_serial, _mix_source, _could), ``gaps`` (_g_source, _left). Each
    round is a running sum in the order of ``_serial`` over the documents that
    are not larger than what is left; it ends when no such document is there.
    """
    of_source = F.col("_mix_source").eqNullSafe(F.col("_g_source"))
    columns = ("_serial", "_mix_source", "_could")
    gaps, turn = lay_down(gaps, "mix-gaps"), 0
    pool = lay_down(pool.join(gaps, of_source).where("_could <= _left").select(*columns), "mix-pool")
    picked = [pool.select("_serial").where(F.lit(False))]
    while not pool.isEmpty():
        large_first = F.floor(F.log2("_could")) if turn >= ROUNDS_IN_ORDER else F.lit(0).cast("bigint")
        rows = pool.withColumns({"_class": large_first, "_block": F.shiftright("_serial", 33)})
        place = ("_mix_source", "_class", "_block")
        before = Window.partitionBy("_mix_source").orderBy(F.desc("_class"), "_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = rows.groupBy(*place).agg(F.sum("_could").alias("_words"))
        blocks = blocks.select(
            *[F.col(c).alias(f"_b{c}") for c in place], F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before")
        )
        inside = Window.partitionBy("_block", "_class", "_mix_source").orderBy("_serial")
        run = (
            rows.withColumn("_run", F.sum("_could").over(inside))
            .join(
                blocks,
                F.col("_mix_source").eqNullSafe(F.col("_b_mix_source"))
                & (F.col("_class") == F.col("_b_class"))
                & (F.col("_block") == F.col("_b_block")),
            )
            .join(gaps, of_source)
        )
        run = lay_down(run.select(*columns, (F.col("_run") + F.col("_before")).alias("_run"), "_left"), "mix-round")
        fits = run.where("_run <= _left")
        picked.append(fits.select("_serial"))
        used = fits.groupBy(F.col("_mix_source").alias("_u_source")).agg(F.max("_run").alias("_used"))
        gaps = lay_down(
            gaps.join(used, F.col("_g_source").eqNullSafe(F.col("_u_source")), "left").select(
                "_g_source", (F.col("_left") - F.coalesce("_used", F.lit(0))).alias("_left")
            ),
            "mix-gaps",
        )
        rest = run.where("_run > _left").select(*columns).join(gaps, of_source)
        pool = lay_down(rest.where("_could <= _left").select(*columns), "mix-pool")
        turn += 1
    return reduce(DataFrame.unionByName, picked), gaps


ADDED = ("_size", "_source_size", "_target", "_rate", "_copies", "_taken")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with _size, _source_size, _target, _rate, _copies and _taken.

    One row per input row; ``_taken = _copies * _size``, ``_copies`` is the rate
    rounded down or up. Within a source, documents are rounded up in the order
    of hash(id) / fraction until the target is met; what is too large for the room
    is passed over and the rest goes on, until the gap is smaller than any document
    that is not rounded up. Where that leaves more, the smallest such document is
    taken and others left out for it in the same way. ``cap`` is a whole number, so no copies exceed it. Empty texts keep
    one copy of no words. Null sources are one source; null ids hash alike, and
    rows that tie keep the order Spark gives them once. An empty table gives an
    empty result. Input columns named as the added ones are replaced; all others
    are kept, whatever their names.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    return _mixed(docs, keep, weights, cap, id_col, text_col, source_col).select("_doc.*", *ADDED)


def _mixed(
    docs: DataFrame, keep: Sequence[str], weights: Sequence[float], cap: float, id_col: str, text_col: str, source_col: str
) -> DataFrame:
    """(_doc, *ADDED): the columns ``keep`` as one, so that none can clash with names used here."""
    if cap != int(cap):
        raise ValueError("the cap on copies must be a whole number")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc"),
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        word_count(F.col(text_col)).alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # texts are stored here once and stay there: only sizes and orders move
    rows = lay_down(rows, "mix-rows")
    sizes = rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"))
    targets = source_targets(sizes, weights, cap)
    dual = multipliers(sizes, targets, cap)
    known = targets.join(dual, targets["source"].eqNullSafe(dual["source"]), "left").select(
        targets["source"].alias("_mix_source"),
        F.col("source_size").alias("_source_size"),
        F.col("target").alias("_target"),
        F.coalesce("lambda", F.lit(0.0)).alias("_lambda"),
        F.coalesce("unit", F.lit(1.0)).alias("_unit"),
    )
    known = lay_down(known, "mix-known")
    rate = F.when(F.col("_size") == 0, F.lit(1.0)).otherwise(
        F.least(
            F.lit(float(cap)),
            F.exp(F.greatest(F.least(F.col("_lambda") * F.col("_size") / F.col("_unit"), F.lit(700.0)), F.lit(-700.0))),
        )
    )
    hashed = (F.shiftright(F.xxhash64(F.col("_id").cast("string"), F.lit("mix")), 11) + F.lit(1 << 52)) / F.lit(float(1 << 53))

    def rated(part: DataFrame, of_source: DataFrame) -> DataFrame:
        """``part`` with its source's figures, _rate, _floor and the place in its source's order."""
        with_rate = (
            part.join(of_source, F.col("_source").eqNullSafe(F.col("_mix_source")))
            .withColumn("_rate", rate)
            .withColumn("_floor", F.floor("_rate"))
            .withColumn("_up", F.when(F.col("_size") > 0, F.col("_rate") - F.col("_floor")).otherwise(0.0))
        )
        order = F.when(F.col("_up") > 0, hashed / F.col("_up"))
        return with_rate.withColumn("_place", F.when(order.isNotNull(), F.struct(order.alias("order"), "_id", "_row")))

    # running words per source: blocks of the stored order, then rows in a block
    light = lay_down(
        rated(rows.drop("_doc"), known)
        .orderBy(F.col("_mix_source"), F.col("_place").asc_nulls_last())
        .select(
            F.monotonically_increasing_id().alias("_serial"), "_mix_source", "_size", "_target", "_floor", "_place",
            F.when(F.col("_place").isNotNull(), F.col("_size")).otherwise(F.lit(0).cast("bigint")).alias("_could"),
        ),
        "mix-ordered",
    ).withColumn("_block", F.shiftright("_serial", 33))
    blocks = light.groupBy("_mix_source", "_block").agg(
        F.sum("_could").alias("_words"), F.sum(F.col("_floor") * F.col("_size")).alias("_sure")
    )
    before = Window.partitionBy("_mix_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("_mix_source")
    blocks = blocks.select(
        F.col("_mix_source").alias("_b_source"),
        F.col("_block").alias("_b_block"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_before"),
        F.sum("_sure").over(everywhere).alias("_sure"),
    )
    inside = Window.partitionBy("_block", "_mix_source").orderBy("_serial")
    run = (
        light.withColumn("_run", F.sum("_could").over(inside))
        .join(
            blocks,
            (F.col("_block") == F.col("_b_block")) & F.col("_mix_source").eqNullSafe(F.col("_b_source")),
        )
        .withColumn("_run", F.col("_run") + F.col("_before"))
        .withColumn("_room", F.col("_target") - F.col("_sure"))
        .where("_could > 0")
    )
    run = lay_down(run.select("_serial", "_mix_source", "_could", "_place", "_run", "_room"), "mix-run")
    used = F.coalesce(F.max(F.when(F.col("_run") <= F.col("_room"), F.col("_run"))), F.lit(0))
    gaps = run.groupBy(F.col("_mix_source").alias("_g_source")).agg((F.min("_room") - used).alias("_left"))
    above = run.where("_run > _room").select("_serial", "_mix_source", "_could")
    fillers, gaps = _fill(above, gaps)
    fillers = lay_down(fillers, "mix-fillers")
    # instead of a gap: the smallest document not taken, and others left out for it;
    # words are whole, so a gap of half a word is the least there is
    least = above.join(fillers, "_serial", "left_anti").groupBy("_mix_source")
    least = least.agg(F.min(F.struct("_could", "_serial")).alias("_least"))
    swaps = gaps.where("_left > 0.5").join(least, F.col("_g_source").eqNullSafe(F.col("_mix_source")))
    swaps = lay_down(
        swaps.select("_g_source", F.col("_left").alias("_gap"), "_least._serial", (F.col("_least._could") - F.col("_left")).alias("_left")),
        "mix-swaps",
    )
    taken = run.where("_run <= _room").select("_serial").unionByName(fillers)
    pool = run.join(taken, "_serial", "left_semi").select((-F.col("_serial")).alias("_serial"), "_mix_source", "_could")
    left_out, over = _fill(pool, swaps.select("_g_source", "_left"))
    better = swaps.drop("_left").join(
        over.withColumnRenamed("_g_source", "_o_source"), F.col("_g_source").eqNullSafe(F.col("_o_source"))
    )
    better = lay_down(better.where("_left < _gap").select("_g_source", F.col("_serial").alias("_new")), "mix-better")
    out = run.join(left_out.select((-F.col("_serial")).alias("_serial")), "_serial", "left_semi")
    out = out.join(better, F.col("_mix_source").eqNullSafe(F.col("_g_source"))).select("_serial")
    # a source's rows up to its cut are rounded up; of the others, and of those left out
    # again, there are no more than one document has words, so they are looked up by row
    cuts = run.where("_run <= _room").groupBy(F.col("_mix_source").alias("_c_source")).agg(F.max("_place").alias("_cut"))
    cut = lay_down(
        known.join(cuts, F.col("_mix_source").eqNullSafe(F.col("_c_source")), "left").drop("_c_source"), "mix-cuts"
    )
    changes = (
        fillers.unionByName(better.select(F.col("_new").alias("_serial")))
        .withColumn("_change", F.lit(1))
        .unionByName(out.withColumn("_change", F.lit(-1)))
    )
    changes = run.join(changes, "_serial").groupBy(F.col("_place._row").alias("_c_row"))
    changes = lay_down(changes.agg(F.sum("_change").alias("_change")), "mix-changes")
    up = F.coalesce(F.col("_place") <= F.col("_cut"), F.lit(False)).cast("bigint")
    return (
        rated(rows, cut)
        .join(changes, F.col("_row") == F.col("_c_row"), "left")
        .withColumn("_copies", F.col("_floor") + up + F.coalesce("_change", F.lit(0)))
        .withColumn("_taken", F.col("_copies") * F.col("_size"))
        .select("_doc", *ADDED)
    )


def take_copies(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Each document as often as ``mix`` takes it, with the columns of ``docs``, whatever their names."""
    mixed = _mixed(docs, docs.columns, weights, cap, id_col, text_col, source_col)
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return mixed.where("_copies > 0").select("_doc", copy.alias("_copy")).select("_doc.*")
