"""A filter of fixed size for keys: it may pass others, it never stops one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 27  # 16 MB, whatever the number of keys
_BLOCK = 15


def slot(key: Column) -> Column:
    return F.pmod(key, F.lit(1 << BITS))


def _fill(found: pa.Table) -> pa.Table:
    at = found.column("at").to_numpy()
    mask = np.zeros(1 << _BLOCK, np.uint8)
    mask[at & ((1 << _BLOCK) - 1)] = 1
    return pa.table({"block": [int(at[0]) >> _BLOCK], "mask": [np.packbits(mask).tobytes()]})


def build(slots: DataFrame) -> np.ndarray:
    """Packed bits of the ``at`` column, filled in blocks; 4096 short rows reach the driver."""
    blocks = (
        slots.select("at")
        .distinct()
        .groupBy(F.shiftright("at", _BLOCK).alias("b"))
        .applyInArrow(lambda t: _fill(t), "block long, mask binary")
    )
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in blocks.collect():
        a = r["block"] << (_BLOCK - 3)
        out[a : a + (1 << (_BLOCK - 3))] = np.frombuffer(r["mask"], np.uint8)
    return out


def passes(mask: np.ndarray, at: int | np.ndarray) -> bool | np.ndarray:
    return mask[at >> 3] & (128 >> (at & 7)) > 0
