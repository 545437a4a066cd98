"""Importance resampling against plain Python: hashes, weights, the draw, and edge rows."""

import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import resampling as R
from flowguard.llm.shared import materialize

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs_of(text, runs):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def brute(documents, target, percent, runs, buckets, least):
    """Rows by definition, in input order; ties of score and id by number of features."""
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in documents]), (t, target)):
        for text in texts:
            for w in runs_of(text, runs)[1]:
                counts[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in documents:
        words, features = runs_of(text, runs)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in features)
        rows.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_crc32s_equal_zlib():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(5000))
    starts = np.array([rng.randrange(4000) for _ in range(400)])
    sizes = np.array([rng.choice([0, 1, 2, 7, 47, 48, 49, 300, 900]) for _ in starts])
    assert list(R.crc32s(np.frombuffer(data, np.uint8), starts, sizes)) == [zlib.crc32(data[a : a + n]) for a, n in zip(starts, sizes)]


@pytest.mark.parametrize(("runs", "percent", "least"), [(1, 10, 20), (2, 35, 3), (3, 100, 0)])
def test_whole_table_by_definition(spark, documents, runs, percent, least):
    target = spark.createDataFrame([("The quick Brown fox9",), (None,), ("été 漢字 fox",)], "text string")
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = R.resample(documents, target, percent=percent, runs=runs, buckets=997, least_words=least)
    assert order(got.collect()) == order(brute(rows, [r.text for r in target.collect()], percent, runs, 997, least))


def test_edge_rows(spark, edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("the lazy dog",)], "text string")
    for percent in (0, 40, 100):
        assert order(R.resample(edge, target, percent=percent, least_words=2).collect()) == order(brute(rows, ["the lazy dog"], percent, 1, 10_000, 2))
    assert R.resample(nothing, target).count() == 0
    assert {r.weight for r in R.resample(edge, nothing, least_words=2).collect() if r.n_features == 0} == {0}


def test_kth_key_among_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), i) for i in range(700)]
    table = materialize(spark.createDataFrame(rows, "a long, b long"))
    ordered = sorted(rows)
    for k in (1, 2, 350, 699, 700):
        assert R.select_kth(table, F.struct("a", "b"), k) == ordered[k - 1]
    assert R.select_kth(table, F.struct("a", "b"), 0) is None
    numbered = R.ranked(table, F.struct("a", "b"), "place").collect()
    assert sorted((r.place, r.a, r.b) for r in numbered) == [(i + 1, *x) for i, x in enumerate(ordered)]


def test_result_does_not_depend_on_partitions(spark, documents):
    target = spark.createDataFrame([("the of and",)], "text string")
    one = R.resample(documents.coalesce(1), target)
    assert order(one.collect()) == order(R.resample(documents.repartition(7), target).collect())
