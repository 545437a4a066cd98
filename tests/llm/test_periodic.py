"""Periodic runs against their definition, on random and on made texts; digests of the query against plain Python."""

import random
import re
import time
import zlib
from hashlib import sha256

import numpy as np
import pytest

from flowguard.llm import periodic as P
from flowguard.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least=6, exponent=4):
    """(start, length, period) of all runs by start and period: for each period, stretches where words equal those one period on."""
    found = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def with_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_random_texts_by_definition():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 60))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randint(2, 9)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        least, exponent = rng.choice([2, 4, 6]), rng.choice([2, 3, 4])
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        before = np.cumsum([0] + [len(t) for t in texts])
        found = P.find_runs(np.array([w for t in texts for w in t], np.int32), text, len(texts), least, exponent)
        got = [[] for _ in texts]
        for first, length, period in zip(*found):
            got[text[first]].append((int(first - before[text[first]]), int(length), int(period)))
        assert got == [brute(t, least, exponent) for t in texts]


def test_suffix_array_and_smaller_values_by_definition():
    rng = random.Random(2)
    for _ in range(100):
        text = [rng.randint(1, 3) for _ in range(rng.randint(0, 50))] + [0]
        order, rank, common = P.suffix_array(np.array(text))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert list(order) == want
        assert [order[k] for k in rank] == list(range(len(text)))
        share = lambda a, b: next(k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1])
        assert list(common[1:]) == [share(a, b) for a, b in zip(want, want[1:])]
        nearest = [next((j for j in range(i + 1, len(common)) if common[j] < common[i]), len(common)) for i in range(len(common))]
        assert list(P.next_smaller(common, np.arange(len(common)))) == nearest


def test_long_texts_take_little_time():
    n = 300_000
    start = time.time()
    assert [tuple(map(int, r)) for r in zip(*P.find_runs(np.zeros(n, np.int32), np.zeros(n, int), 1))] == [(0, n, 1)]
    assert [tuple(map(int, r)) for r in zip(*P.find_runs(np.arange(n, dtype=np.int32) % 9_000, np.zeros(n, int), 1))] == [(0, n, 9_000)]
    assert time.time() - start < 60


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_query_by_definition(spark, sf_dir, rows):
    """Whole rows for every text of up to 1,500 words, tails included."""
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    tails = compared = 0
    for doc_id, text in rows.items():
        plain = WORD.findall(text or "")
        words = with_tail(doc_id, plain)
        if len(words) > 1_500:
            continue
        runs = brute(words)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (None if best is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed(words, runs).encode()).hexdigest()
        compared, tails = compared + 1, tails + (words != plain)
    assert compared > 150
    assert tails > 5


def test_edge_rows(spark, edge, nothing):
    got = P.detect_runs(edge).collect()
    assert len(got) == edge.count()
    by_id = {r.doc_id: r for r in got}
    for doc_id in (1, 2, 3):
        assert (by_id[doc_id].n_words, by_id[doc_id].runs, by_id[doc_id].collapsed) == (0, [], "")
    assert [tuple(x) for x in by_id[6].runs] == [(0, 60_000, 1)]
    assert by_id[6].collapsed == "word"
    assert by_id[7].collapsed == "x" * 200_000
    assert by_id[9].collapsed == "héé 漢字 👍🏽 İıΣς"
    assert P.detect_runs(nothing).count() == 0


def test_runs_that_overlap_and_touch(spark):
    text = "a b a b a b a b x x x x x x y a a a a a b a a a a a b a a a a a b a a a a a b"
    (row,) = P.detect_runs(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, start string")).collect()
    assert [tuple(x) for x in row.runs] == brute(text.split()) == [(0, 8, 2), (8, 6, 1), (15, 24, 6)]
    assert row.collapsed == collapsed(text.split(), brute(text.split())) == "a b x y a a a a a b"
