import hashlib
import random

from pyspark.sql import functions as F

from flowguard.llm import fingerprints as fp
from flowguard.llm import queries


def test_report_equals_brute_force(spark, sf_dir, documents):
    rows = sorted(documents.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    got = {r["doc_id"]: r for r in queries.op1_simhash(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, u = r["text"] or "", nxt["text"] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        wrong = bin(int(g["fingerprint"], 16) ^ int(got[nxt["doc_id"]]["fingerprint"], 16)).count("1")
        assert abs(g["near_next"] - (1 - wrong / 64)) < 1e-12
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], got[r["doc_id"]]["fingerprint"]) == got[r["doc_id"]]["fingerprint"]
    values = [int(g["fingerprint"], 16) for g in got.values()]
    for i, g in got.items():
        want = sum(bin(int(g["fingerprint"], 16) ^ v).count("1") <= 3 for v in values) if i % 20 == 0 else None
        assert g["n_near"] == want
    edited, unrelated = (sum(getattr(g, c) for g in got.values()) / len(got) for c in ("near_edited", "near_next"))
    assert edited > unrelated + 0.02


def test_votes_equal_brute_force(spark):
    texts = ["alpha beta gamma", "Alpha  beta\nbeta", "", "one", "the the the longerword"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    words = sorted({w for t in texts for w in t.lower().split()})
    hashes = {r[0]: r[1] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    weight = lambda w: 1 if len(w) <= 3 else 3 if len(w) <= 6 else 5
    for r in fp.fingerprints(frame, ["k"]).collect():
        want, all_votes = 0, sum(weight(w) for w in texts[r["k"]].lower().split())
        for bit in range(64):
            if 2 * sum(weight(w) for w in texts[r["k"]].lower().split() if hashes[w] >> bit & 1) > all_votes:
                want |= 1 << bit
        assert r["fingerprint"] & (2**64 - 1) == want


def test_block_tables_find_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(15)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {(r["query"], r["fingerprint"]) for r in fp.within_radius(frame, frame).collect()}
    assert got == {(signed[i], signed[j]) for i, a in enumerate(values) for j, b in enumerate(values) if bin(a ^ b).count("1") <= 3}


def test_next_across_cells(spark):
    rows = [(i * i, f"t{i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(frame, rows_per_cell=7).collect()}
    assert got == {i: t for (i, _), (_, t) in zip(rows, rows[1:] + rows[:1])}


def test_edges(edge, nothing):
    rows = fp.fingerprint_report(edge).collect()
    assert len(rows) == edge.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fp.fingerprint_report(nothing).count() == 0
    assert fp.fingerprint_report(edge.where("doc_id = 8")).first()["near_next"] == 1.0


def test_next_with_gaps_clusters_and_ties(spark):
    ids = [None] * 60 + [-(2**63), 2**63 - 1, 10**15] + [10**12 + i for i in range(80)] + list(range(50)) + [7] * 40
    rows = [(i, f"t{n}") for n, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    u = {r["text"]: r["u"] for r in frame.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, u[r[1]], r[1]))
    want = {t: (n, nt) for (_, t), (n, nt) in zip(order, order[1:] + order[:1])}
    got = fp.with_next(frame, rows_per_cell=3)
    assert {r["text"]: (r["next_id"], r["next_text"]) for r in got.collect()} == want and got.count() == len(rows)
    keys = frame.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("u"))
    bits, tables = fp._cells(keys, 3, 65536)
    assert tables and fp._placed(keys, bits, tables, 65536).groupBy("start", "part").count().agg(F.max("count")).first()[0] <= 24
