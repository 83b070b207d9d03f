"""Readers and writers of entry tables, dataset versions and results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong import settings
from furlong.sources.schema import ENTRY_SCHEMA, assert_string_ids


def _csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_entries(
    spark: SparkSession,
    path: str,
    schema: T.StructType = ENTRY_SCHEMA,
    partitions: int | None = None,
) -> DataFrame:
    """Read a (gzip) CSV entry table with a fixed schema.

    A value that does not parse as its type fails the read. Columns are matched
    by name; those the schema does not know are read as
    strings, never guessed. One gzip file is one task: give ``partitions`` to
    spread its rows before further work, or store them once with ``store_entries``.
    """
    known = {f.name: f for f in schema}
    header = _csv_header(spark, path)
    full = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    df = (
        spark.read.schema(full)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    assert_string_ids(df, [c for c in settings.ID_COLUMNS if c in header])
    return df.repartition(partitions) if partitions else df


def store_entries(df: DataFrame, path: str, date: str = "race_date") -> None:
    """Keep an entry table as parquet by venue and year, in files of like size."""
    (
        df.withColumn("year", F.year(date))
        .repartitionByRange("venue", "year", date, "race_id", F.xxhash64("hrNo"))
        .write.mode("overwrite")
        .partitionBy("venue", "year")
        .parquet(path)
    )


def guard_version(version: str, purpose: str) -> str:
    """Refuse dataset versions v5-v8 for training."""
    if purpose not in ("train", "inspect", "reproduce"):
        raise ValueError(f"unknown purpose {purpose!r}")
    if purpose == "train" and version.split("_")[0] in settings.RETIRED_FOR_TRAINING:
        raise PermissionError(f"{version} must not be used for new training")
    return version


def write_version(df: DataFrame, base: str, version: str, split: str = "split") -> None:
    """Write one dataset version, a folder per split; other versions stay untouched."""
    (
        df.withColumn("version", F.lit(version))
        .withColumnRenamed(split, "split")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version", "split")
        .parquet(base)
    )


def read_split(
    spark: SparkSession, base: str, version: str, split: str, purpose: str = "inspect"
) -> DataFrame:
    """Read one version and split from its folder, with the columns that version has."""
    guard_version(version, purpose)
    if split not in ("train", "valid", "test"):
        raise ValueError(f"unknown split {split!r}")
    folder = f"{base}/version={version}/split={split}"
    df = spark.read.option("basePath", base).parquet(folder)
    return assert_string_ids(df, [c for c in settings.ID_COLUMNS if c in df.columns])


def read_split_csv(
    spark: SparkSession, base: str, version: str, split: str, purpose: str = "inspect",
    schema: T.StructType = ENTRY_SCHEMA,
) -> DataFrame:
    """Read ``<base>/<version>/<split>.csv.gz``, the layout the datasets are handed over in."""
    guard_version(version, purpose)
    return read_entries(spark, f"{base}/{version}/{split}.csv.gz", schema).withColumns(
        {"version": F.lit(version), "split": F.lit(split)}
    )


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json") -> DataFrame:
    """Read collected files as they landed, with a fixed schema; a record that breaks it fails the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if form == "csv":
        return reader.option("header", True).csv(path)
    if form == "json":
        return reader.json(path)
    raise ValueError(f"unknown form {form!r}")


def split_by_purpose(df: DataFrame, spec: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One narrower table per purpose."""
    return {purpose: df.select(*cols) for purpose, cols in spec.items()}


def write_purposes(tables: Mapping[str, DataFrame], base: str) -> None:
    for purpose, table in tables.items():
        table.write.mode("overwrite").parquet(f"{base}/{purpose}")


def write_result(df: DataFrame, base: str, name: str, form: str = "parquet") -> str:
    """Write a result table under the fixed name later steps read it by."""
    path = f"{base}/{name}"
    writer = df.write.mode("overwrite")
    if form == "parquet":
        writer.parquet(path)
    elif form == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown form {form!r}")
    return path


def read_result(
    spark: SparkSession, base: str, name: str, form: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if form == "parquet":
        return reader.parquet(f"{base}/{name}")
    if form == "csv":
        return reader.option("header", True).csv(f"{base}/{name}")
    raise ValueError(f"unknown form {form!r}")
