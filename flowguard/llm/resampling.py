"""Importance resampling of documents towards a target set of texts.

Features are runs of words, counted in a fixed number of hash buckets; a bucket's gain is the logarithm of how much more often
the target has it than the documents. A document's weight is the sum of its features' gains, read from one array. Gumbel noise
from its id makes drawing without replacement a matter of taking the highest scores (Xie et al. 2023; Efraimidis and Spirakis
2006), and distributed quickselect finds the last of them: random pivot keys, exact counts of rows before, at and after each,
then the same between two of them. Winners alone are sorted and ranked.

Null and empty texts have no features and weight 0. A null doc_id sorts last and takes part by the noise of an empty id. Rows
that share a doc_id are rows of their own; where score and id tie, the row with fewer features is drawn first, and rows equal in
that too are interchangeable. Other columns, whatever they are called, are left out. Empty tables give no rows and no counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, slices, utf8

#: How many pivot keys a round of quickselect counts around.
PIVOTS = 24
#: Runs of more bytes are hashed one by one.
_LONG = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of bytes, all stretches a byte at a time together."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")[::-1]
    long = int(np.searchsorted(-sizes[order], -_LONG, "left"))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    order = order[long:]
    at, crc, ends = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32), -sizes[order]
    for p in range(int(-ends[0]) if len(ends) else 0):
        m = int(np.searchsorted(ends, -p, "left"))
        crc[:m] = _CRC[(crc[:m] ^ data[at[:m] + p]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    return out


def run_hashes(data: np.ndarray, offsets: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each run of 1 to `runs` words joined by a space, number of its text, words of each text)."""
    texts = len(offsets) - 1
    low = _LOWER[data]
    inside = np.r_[_WORD[low], False]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first | np.r_[True, ~inside[:-1]]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])) + 1
    sizes, text = ends - starts, np.searchsorted(offsets, starts, "right") - 1
    hashes, owners = [crc32s(low, starts, sizes)], [text]
    if runs > 1 and len(starts):
        at = np.r_[0, np.cumsum(sizes + 1)]
        joined, step = np.full(at[-1], 32, np.uint8), np.arange(sizes.sum())
        before = np.cumsum(sizes) - sizes
        joined[np.repeat(at[:-1] - before, sizes) + step] = low[np.repeat(starts - before, sizes) + step]
        for n in range(2, runs + 1):
            i = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, int)
            hashes.append(crc32s(joined, at[i], at[i + n] - 1 - at[i]))
            owners.append(text[i])
    return np.concatenate(hashes), np.concatenate(owners), np.bincount(text, minlength=texts)


def _histogram(runs: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _ = run_hashes(*utf8(part.column("text")), runs)
                total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; buckets without a feature are absent. A task sends one row for each bucket that it met."""
    return texts.select("text").mapInArrow(_histogram(runs, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket in thousandths, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); `buckets` bounds what the driver reads."""
    either = bucket_counts(documents, runs, buckets).withColumn("side", F.lit(0)).unionAll(bucket_counts(target, runs, buckets).withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets))
    for bucket, n, side in either.collect():
        counts[side, bucket] = n
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weigh(documents: DataFrame, gains: np.ndarray, runs: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document; the gains travel to the tasks as one array."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text, words = run_hashes(*utf8(part.column("text")), runs)
                features, total = np.bincount(text, minlength=part.num_rows), np.zeros(part.num_rows, np.int64)
                np.add.at(total, text, gains[hashes % np.uint32(len(gains))])
                columns = [pa.array(x.astype(np.int64)) for x in (words, features, total)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return documents.select("doc_id", "text").mapInArrow(weights, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 over `seed:doc_id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def select_kth(rows: DataFrame, key: Column, k: int) -> tuple | None:
    """The k-th smallest key (a struct without equals) of a written table, as a row; None if k is 0.

    Each round draws PIVOTS keys between the bounds by a hash of key and round, counts exactly what lies between, at and beyond
    them, and goes on inside the one part that holds the k-th. No rows are sorted, and none but the pivots reach the driver.
    """
    if k < 1:
        return None
    left, turn = rows.select(key.alias("key")), 0
    names = left.schema["key"].dataType.names
    lit = lambda p: F.struct(*[F.lit(v).cast(left.schema["key"].dataType[n].dataType).alias(n) for n, v in zip(names, p, strict=True)])
    while True:
        turn += 1
        drawn = left.orderBy(F.xxhash64("key", F.lit(turn)), "key").limit(PIVOTS)
        pivots = [tuple(r.key) for r in drawn.orderBy("key").collect()]
        place = sum((F.when(F.col("key") > lit(p), 2).when(F.col("key") == lit(p), 1).otherwise(0) for p in pivots), F.lit(0))
        counts = sorted(map(tuple, left.groupBy(place.alias("place")).count().collect()))
        for at, n in counts:  # noqa: B007
            if k <= n:
                break
            k -= n
        if at % 2:
            return pivots[at // 2]
        if at:
            left = left.where((F.col("key") > lit(pivots[at // 2 - 1])))
        if at // 2 < len(pivots):
            left = left.where(F.col("key") < lit(pivots[at // 2]))


def ranked(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """rows with their number by key from 1: dealt to ranges that are written, so that numbers carry on from range to range."""
    dealt = rows.withColumn("_key", key).repartitionByRange("_key").withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt)
    before, total = [], 0
    for part, n in sorted(map(tuple, dealt.groupBy("_range").count().collect())):  # as many rows as there are ranges
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_range int, _before long")
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, inside + F.col("_before")).drop("_range", "_before", "_key")


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the N documents with least_words words or more, the floor(percent N / 100) highest scores are drawn.
    """
    scored = weigh(documents, bucket_gains(documents, target, runs, buckets), runs)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored)
    fit = F.col("n_words") >= least_words
    key = F.struct((-F.col("score")).alias("high"), F.col("doc_id").isNull().alias("none"), "doc_id", "n_features", "row")
    k = scored.where(fit).count() * percent // 100
    last = select_kth(scored.where(fit), key, k)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    types = scored.select(key.alias("key")).schema["key"].dataType
    end = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(types, last, strict=True)])
    won = fit & (key <= end)
    winners = ranked(scored.where(won), key, "rank")
    return winners.select(*columns, F.col("rank").cast("long")).unionAll(scored.where(~won).select(*columns, F.lit(None).cast("long").alias("rank")))
