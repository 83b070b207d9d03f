"""Exact deduplication by salted digest groups that compare whole contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.scale.storage import lay_down

SALTS = 16
# Digest collisions are looked up by broadcast up to this many digests.
FEW_DIGESTS = 10_000
# Digests that occur again are marked in this many bits, 64 to a broadcast row: at most
# a million rows. The more are marked, the more texts without a copy move with the copies.
MARKS = 1 << 26


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty.

    The pattern leaves out the run that would not change, a lone space.
    """
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text) groups: smallest id and rows, merged in three stages.

    The text is part of every grouping key, so each stage compares contents: map
    tasks combine their own copies, salted groups combine those of a hot text in
    ``salts`` places, and the last stage sees at most ``salts`` rows a text.
    """
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_norm").agg(
        F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("_digest", "_norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def _mark(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(MARKS))


def _marks(light: DataFrame) -> DataFrame:
    """Stored (_word, _bits): the marks of digests that more than one row has."""
    again = light.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    mark = again.select(_mark(F.col("_digest")).alias("_mark"))
    bit = F.expr("shiftleft(1L, cast(_mark & 63 AS int))")
    return lay_down(mark.groupBy(F.shiftright("_mark", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "digest-marks")


def _split(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose digest is unmarked, so that no other row has their text, and the rest; neither moves."""
    mark = _mark(F.col("_digest"))
    found = rows.join(F.broadcast(marks), F.shiftright(mark, 6) == F.col("_word"), "left")
    marked = F.expr(f"coalesce(shiftright(_bits, cast(pmod(xxhash64(_digest), {MARKS}L) & 63 AS int)) & 1, 0) = 1")
    return found.where(~marked).select(rows.columns), found.where(marked).select(rows.columns)


def _hashed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"), *more)
    return rows.withColumn("_digest", digest(F.col("_norm")))


def _judged(
    docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(_id, keep_id, group_size, text_sha256) of rows without copies and of the others, and the marks."""
    rows = _hashed(docs, id_col, text_col, digest)
    light = lay_down(rows.select("_id", "_digest", sha256(F.col("_norm")).alias("text_sha256")), "exact-digests")
    marks = _marks(light)
    columns = ["_id", "keep_id", "group_size", "text_sha256"]
    alone, light = _split(light, marks)
    alone = alone.withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("bigint")}).select(*columns)
    rows = _split(rows, marks)[1]
    by_digest = _winners(rows, salts).groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"),
        F.min("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size"),
    )
    # stored, so that the join below deals both sides anew and can split a hot digest
    by_digest = lay_down(by_digest, "exact-groups")
    collided = by_digest.where("_texts > 1").select("_digest")
    few = collided.limit(FEW_DIGESTS + 1).count()
    out = light.join(by_digest.where("_texts = 1"), "_digest").select(*columns)
    if few:
        hint = F.broadcast(collided) if few <= FEW_DIGESTS else collided
        again = rows.join(hint, "_digest", "left_semi")
        exact = again.join(_winners(again, salts), ["_digest", "_norm"])
        out = out.unionByName(exact.withColumn("text_sha256", sha256(F.col("_norm"))).select(*columns))
    return alone, out, marks


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after white-space normalisation. The smallest id
    of a group stays. Null and empty texts are one group; null ids lose to any
    other id, and a group of null ids keeps all its rows (keep_id null). Rows
    that tie on the smallest id of a group are all marked kept. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    A row whose digest no other row has is a group of its own and its text stays
    where it is; the texts of all others meet. ``digest`` only routes rows: a weak
    one costs time, never correctness.
    """
    alone, rest, _ = _judged(docs, id_col, text_col, salts, digest)
    return alone.unionByName(rest).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per normalised text, all columns kept, whatever their names.

    Of rows that tie on id and text one stays, chosen by Spark. Rows without a
    copy do not move.
    """
    _, rest, marks = _judged(docs, id_col, text_col, SALTS, sha256)
    stay = rest.where(F.col("_id").eqNullSafe(F.col("keep_id"))).groupBy("_id", "text_sha256")
    stay = lay_down(stay.agg(F.count(F.lit(1)).alias("_ties")), "exact-kept")
    stay = stay.select(F.col("_id").alias("_keep"), F.col("text_sha256").alias("_sha"), "_ties")
    # the caller's columns travel as one, so that none can clash with names used here
    rows = _hashed(docs, id_col, text_col, sha256, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    alone, here = _split(rows.drop("_norm"), marks)
    same = F.col("_digest").eqNullSafe(F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_keep"))
    out = alone.unionByName(here.join(stay.where("_ties = 1"), same, "left_semi"))
    if stay.where("_ties > 1").limit(1).count():
        ties = here.join(stay.where("_ties > 1"), same, "left_semi")
        out = out.unionByName(ties.dropDuplicates(["_id", "_digest"]))
    return out.select("_doc.*")
