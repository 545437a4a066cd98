"""Reading and writing flow tables, alerts and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.schema import text_schema
from flowguard.sources.scratch import open_folders, paths

#: What the bytes 80 to 9F mean in the Windows code page, as their Unicode characters; five are unused.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_C1 = "".join(map(chr, range(0x80, 0xA0)))


def read_flows(spark: SparkSession, path: str, columns: list[str], encoding: str | None = None) -> DataFrame:
    """One headered CSV, or a folder of them, with every column as text."""
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
    return (reader.option("encoding", encoding) if encoding else reader).csv(path)


def read_many(spark: SparkSession, globs: list[tuple[str, list[str]]]) -> DataFrame:
    """All files of several patterns stacked by column name; a column that a pattern lacks is null there. source says which file a row came from."""
    out = None
    for glob, columns in globs:
        part = read_flows(spark, glob, columns).withColumn("source", F.input_file_name())
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def from_cp1252(c: Column) -> Column:
    """Text that was read as ISO-8859-1 but written in the Windows code page."""
    return F.translate(c, _C1, CP1252)


def to_cp1252(c: Column) -> Column:
    """Text to be written as ISO-8859-1 so that its bytes are the Windows code page's."""
    return F.translate(c, CP1252, _C1)


def first_path(spark: SparkSession, glob: str) -> str:
    """The first path of a pattern by name."""
    found = paths(spark, glob)
    if not found:
        raise FileNotFoundError(glob)
    return found[0]


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of several paths that exists."""
    for path in candidates:
        if paths(spark, path):
            return path
    raise FileNotFoundError(", ".join(candidates))


def write_mapped(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The mapped table, one folder for each domain."""
    with open_folders(df.sparkSession):
        df.write.mode("overwrite").partitionBy("domain").format(kind).save(path)


def write_matrices(df: DataFrame, path: str) -> None:
    """Features, label and split of every row."""
    with open_folders(df.sparkSession):
        df.write.mode("overwrite").partitionBy("split").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One headered CSV file, for people; meant for the bounded alert log."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
