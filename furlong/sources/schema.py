"""Known columns and the string-identifier contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furlong import settings

# The columns whose names are known, with the types they need.
ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("race_id", T.StringType()),
        T.StructField("race_date", T.DateType()),
        T.StructField("venue", T.StringType()),
        T.StructField("hrNo", T.StringType()),
        T.StructField("jkNo", T.StringType()),
        T.StructField("trNo", T.StringType()),
        T.StructField("owNo", T.StringType()),
        T.StructField("winOdds", T.DoubleType()),
        T.StructField("win", T.IntegerType()),
        T.StructField("upset_A", T.IntegerType()),
        T.StructField("upset_B", T.IntegerType()),
    ]
)

# What each known column may be used for.
ENTRY_ROLES = {
    "race_id": "id",
    "race_date": "time",
    "venue": "feature",
    "hrNo": "id",
    "jkNo": "id",
    "trNo": "id",
    "owNo": "id",
    "winOdds": "market",
    "win": "label",
    "upset_A": "label",
    "upset_B": "label",
}


def assert_string_ids(df: DataFrame, ids: Sequence[str] = settings.ID_COLUMNS) -> DataFrame:
    """Refuse a table whose identifiers are not strings: leading zeros would be gone."""
    for name in ids:
        if name not in df.columns:
            raise ValueError(f"identifier {name} is missing")
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise TypeError(f"identifier {name} must be a string, got {df.schema[name].dataType}")
    return df


def with_features(schema: T.StructType, features: Sequence[str]) -> T.StructType:
    """The schema with further numeric columns."""
    return T.StructType(list(schema) + [T.StructField(f, T.DoubleType()) for f in features])
