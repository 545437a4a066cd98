"""Near-duplicate documents by min-max hashing.

Every word shingle gets a 64-bit hash. Each permutation of the hashes yields two values, its minimum and its maximum, so
a signature of 2p values takes p evaluations. Bands of these values name buckets; documents that share one are compared
on their full shingle sets, and linked documents form components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import MOST_NODES, linked_components
from .shared import discard, materialize, mix, slices, small, utf8, word_hashes


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `words` words. A shorter text is one shingle as a whole; one without words has none."""
    data, offsets = utf8(text)
    w, of = word_hashes(data, offsets)
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    with np.errstate(over="ignore"):
        if len(w) >= words:
            h = np.zeros(len(w) - words + 1, np.uint64)
            for i in range(words):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - words + 1 + i] + np.uint64(i + 1))
        else:
            h = np.zeros(0, np.uint64)
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= words:
                out.append(np.unique(h[lo : hi - words + 1]))
            elif hi > lo:
                x = np.uint64(hi - lo)
                for v in w[lo:hi]:
                    x = mix(x * np.uint64(0xA0761D6478BD642F) + v)
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _hex(x: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums of differently mixed values, with its size."""
    with np.errstate(over="ignore"):
        a = mix(x + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        b = mix(x ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64) + np.uint64(len(x))
        return a.tobytes() + b.tobytes()


class _Signer:
    """Signatures of shingle sets, and their band keys: `bands` keys of `rows` values, half of them minima and half maxima."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.half = bands, rows // 2
        rng = np.random.default_rng(2718)
        count = bands * self.half
        self.mul = (rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The minimum and the maximum of the set under each permutation."""
        lo = hi = None
        for i in range(0, len(x), 1024):
            y = np.multiply.outer(self.mul, x[i : i + 1024]) + self.add[:, None]
            a, b = y.min(1), y.max(1)
            lo, hi = (a, b) if lo is None else (np.minimum(lo, a), np.maximum(hi, b))
        return np.stack([lo, hi])

    def keys(self, ends: np.ndarray) -> np.ndarray:
        used = ends.reshape(len(ends), 2, self.bands, self.half)
        k = np.arange(1, self.bands + 1, dtype=np.uint64)[None, :].repeat(len(ends), 0)
        for end in range(2):
            for i in range(self.half):
                k = mix(k * np.uint64(0xD6E8FEB86659FD93) + used[:, end, :, i])
        return k.view(np.int64)


def signatures(documents: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, code, keys) of every document; code stands for its shingle set and is null if that is empty."""
    schema = T.StructType([
        T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n", T.LongType()),
        T.StructField("code", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(bands, rows)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), words)
                full = [x for x in sets if len(x)]
                with np.errstate(over="ignore"):
                    keys = signer.keys(np.stack([signer.ends(x) for x in full])) if full else np.zeros((0, bands), np.int64)
                has = np.array([len(x) > 0 for x in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has * bands)].astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_hex(x) if len(x) else None for x in sets], pa.binary()), lists],
                    names=["doc_id", "n", "code", "keys"],
                )

    return documents.select("doc_id", "text").mapInArrow(sign, schema)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(code, s) of every text that has words: its shingle set and what stands for it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [x for x in shingle_sets(part.column("text"), words) if len(x)]
                at = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_hex(x) for x in sets], pa.binary()), lists], names=["code", "s"])

    return texts.select("text").mapInArrow(cut, "code binary, s array<bigint>")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents (doc_id, text, ...).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct `words`-word shingles
    (words: runs of other characters than space and U+0009 to U+000D, A-Z lower-cased). component_id is the smallest
    doc_id reachable over links, kept says whether it is the row's own.

    A null or blank text has n_shingles 0, is linked with nothing and is kept. A text of fewer words is one shingle.
    Texts with equal sets are one class from the start. Rows that repeat a doc_id are judged by their own texts; equal
    rows get equal results. A null doc_id counts as larger than any other; a component of such rows alone has a null
    component_id and keeps them. Other columns, whatever their names, are not read. An empty table gives none.
    """
    signed = materialize(signatures(documents, words, bands, rows))
    classes = signed.where("n > 0").groupBy("code").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(classes.join(small(nodes, MOST_NODES), "node", "left_semi").select("node", "code", "least"))
        ids = wanted.select(F.col("least").alias("doc_id")).distinct()
        texts = documents.select("doc_id", "text")
        found = texts.join(small(materialize(ids), MOST_NODES), "doc_id", "left_semi").unionAll(texts.where("doc_id is null"))
        return _sets(found, words).join(small(wanted, MOST_NODES), "code").select("node", "s").dropDuplicates(["node"])

    found = linked_components(classes.select(F.explode("keys").alias("bucket"), "node"), sets_of, percent)
    return _labelled(signed, classes, found)


def _labelled(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    least = classes.select("code", "node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(least.select("code", "component").join(smallest, "component").select("code", "component_id"))
    discard(classes, found)
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "code").join(of, "code", "left")
    out = out.withColumn("component_id", F.when(F.col("code").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
