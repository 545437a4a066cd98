"""What several operators use: written tables that cut lineage, slices of Arrow batches, byte-level word hashes."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete what materialize() has written; frames that read it can no longer be used."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with the cluster
            continue


atexit.register(release)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/flowguard-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame, shuffles: bool = True) -> None:
    """Delete tables that materialize() has written once nothing will read them any more; other frames are left alone.

    Spark deletes the shuffle files behind them when the driver has collected their plans, so that is asked for too,
    but for short loops, whose files can wait for the next call.
    """
    mine = {getattr(df, "_written_to", None) for df in frames}
    gone = [x for x in _written if x[1] in mine]
    for item in gone:
        _written.remove(item)
        _delete(*item)
    if gone and shuffles:
        gone[0][0]._jvm.System.gc()


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more, before as large ones are written.

    The driver has to collect its garbage for that, and one collection right after a job comes too early: Py4J lets go of
    the JVM's objects up to a second after Python has. Within discard(), which runs often, the next call makes up for it.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        spark._jvm.System.gc()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a written frame for broadcast if it has at most so many rows; otherwise leave the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch whose text in `column` has about `limit` bytes; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(size), 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: An odd multiplier and its inverse modulo 2^64: a word's hash is its polynomial in the one, moved to its start by the other.
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the text it stands in). Words are runs of other bytes than space and 9 to 13; A-Z are lower-cased."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside & (first | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(np.r_[inside[:-1] & (~inside[1:] | first[1:])]) + 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(n, _R, np.uint64))
        total = np.r_[np.uint64(0), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)]
        back = np.multiply.accumulate(np.full(n, _RINV, np.uint64))
        out = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return out, np.searchsorted(offsets, starts, "right") - 1
