"""A folder that driver and executors share, for tables that one step writes and the next reads."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or its warehouse where that is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path for a table or model that goes when the program ends."""
    path = f"{shared_dir(spark)}/flowguard-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def release() -> None:
    """Delete what lies at fresh paths."""
    while _made:
        try:
            delete(*_made.pop())
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with the cluster
            continue


@contextmanager
def open_folders(spark: SparkSession, most: int = 16) -> Iterator[None]:
    """Writes into folders by a column's value, without a sort of all rows of a task by that column beforehand: the files of up to
    so many folders stay open in a task, and only from the next folder on its remaining rows are sorted."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write a frame as Parquet, in a folder for each value of `by` if given, and read it back: its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    with open_folders(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that written() has made once nothing will read them any more; other frames are left alone."""
    gone = {getattr(df, "_written_to", None) for df in frames}
    for item in [x for x in _made if x[1] in gone]:
        _made.remove(item)
        delete(*item)


def paths(spark: SparkSession, glob: str) -> list[str]:
    """What a pattern finds in any file system that Spark knows, sorted."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])
