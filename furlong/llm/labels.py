"""Which labelled rows may be learned from, and which are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 3
HELD_OUT = 1


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learnable(labels: DataFrame, column: str, id_col: str = "doc_id") -> DataFrame:
    """(_label_id, _label): ids outside the held-out fold with label 0 or 1.

    An id labelled more than once counts as positive when most of its labels are.
    """
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg((F.avg(column) > 0.5).cast("int").alias("_label"))
    )
