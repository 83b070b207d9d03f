"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}
_made: list[str] = []

_SPLIT_CONF = "spark.sql.files.maxPartitionBytes"
# Sessions whose splits are small now: how many callers want that, and the setting before.
_small: dict[SparkSession, tuple[int, str | None]] = {}
_small_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster session
    is refused, because its executors would not see a machine-local one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="furlong-")
    return _local[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/furlong-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def made() -> tuple[str, ...]:
    """Paths of the intermediate tables stored so far and not dropped."""
    return tuple(_made)


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove some intermediate tables; results that read them end with it."""
    for path in paths:
        if path in _made:
            _made.remove(path)
            _delete(spark, path)


def drop_laid_down(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that read them end with it."""
    _made.clear()
    _delete(spark, _app_dir(spark))


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; ``drop`` removes what is written there."""
    path = f"{_app_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def lay_down(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, and fixes values that depend on
    the physical layout so that every later reader sees the same ones.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_splits(spark: SparkSession, most: int) -> Iterator[None]:
    """Tasks that begin to read files meanwhile take at most ``most`` bytes, or fewer if the session says so.

    Callers may overlap, in several threads too; the last one out restores the setting.
    """
    with _small_lock:
        callers, before = _small.get(spark, (0, None))
        if not callers:
            now = spark.conf.get(_SPLIT_CONF)
            if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > most:
                before = now
                spark.conf.set(_SPLIT_CONF, str(most))
        _small[spark] = (callers + 1, before)
    try:
        yield
    finally:
        with _small_lock:
            callers, before = _small.pop(spark)
            if callers > 1:
                _small[spark] = (callers - 1, before)
            elif before is not None:
                spark.conf.set(_SPLIT_CONF, before)
