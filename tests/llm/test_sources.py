"""URL rules, archives, mixing and audio."""

import re
import math

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from flowguard.llm import chroma, mixing, queries, urlfilter, warc


def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op3_url_rules", "op5_warc", "op6_mix"])
def test_equals_sql(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    want = duck(sf_dir).sql(f"select {', '.join(out.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    tidy = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(tidy, map(tuple, out.collect())), key=str) == sorted(map(tidy, want), key=str)


PAGES = "page_id bigint, url string, html string, host string, digest string, token string"


def test_url_rules(spark):
    urls = {
        1: ("http://WWW.Example.COM/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        3: ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        4: ("https://x.net/es/1?q#f", "x.net", "/es/1", "net/es/", "block"),
        5: ("https://x.net/es", "x.net", "/es", None, "allow"),
        6: ("http://com", "com", "", None, "allow"),
        7: ("x.net/es/", "", "", None, "allow"),
        8: (None, "", "", None, "allow"),
        9: ("http://m.spam-farm.org/", "m.spam-farm.org", "/", None, "block"),
        10: ("http://m.spam-farm.com/", "m.spam-farm.com", "/", "com/", "allow"),
        11: ("http://spam-farms.org/", "spam-farms.org", "/", None, "allow"),
        12: ("http://u://net/fr/", "u:", "//net/fr/", None, "allow"),
        None: ("http://net?x=/es/", "net", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], None, "h", "d", "t") for i, u in urls.items()], PAGES)
    rules = urlfilter.rule_frame(spark, urlfilter.site_rules(urlfilter.SITE_RULES) + urlfilter.label_rules(urlfilter.BAD_LABELS))
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {i: u[1:] for i, u in urls.items()}
    pattern = spark.createDataFrame([("any9", "block", "9$", 0, 1, [])], rules.schema)
    nines = urlfilter.judge_urls(pages.withColumn("url", F.concat("url", F.lit("9"))), rules.unionAll(pattern))
    assert nines.where("verdict = 'block'").count() > 3
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_archive_round_trip(spark):
    rows = [(i, f"http://a/{i}\r\nx", f"<p>page {i % 7} é</p>" * 30, "h", "d", "t") for i in range(60)]
    rows += [(60, None, None, None, None, None), (61, "u", "", "h", "d", "t"), (None, "u", "alone", "h", "d", "t"), (None, "u", None, "h", "d", "t"), (59, "http://b", rows[59][2], "h", "d", "t")]
    out = warc.round_trip(spark.createDataFrame(rows, PAGES), payloads=True).collect()
    assert len(out) == len(rows)
    last = {}
    for i, _, html, *_ in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", -1))
    by = {}
    for r in out:
        by.setdefault(r["page_id"], []).append(r)
    for i, _, html, *_ in rows:
        for r in by[i]:
            if i is None:
                continue
            assert r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == warc.sha1_base32((html or "").encode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if i == last[html or ""] else ("revisit", last[html or ""]))
            assert bytes(r["payload"]) == ((html or "").encode() if r["record_type"] == "response" else b"")
    assert sorted(r["record_type"] for r in by[None]) == ["response", "revisit"]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_reader_validates():
    dictionary = zstandard.train_dictionary(4096, [f"<html>{i} common words in every page {i * i}</html>".encode() * 5 for i in range(400)]).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    raw = [warc.record(i, "http://a", b"x" * (i * 1000), None, False) for i in range(5)]
    for lead in (warc.dictionary_frame(dictionary), b"\x5d\x2a\x4d\x18" + len(dictionary).to_bytes(4, "little") + dictionary):
        archive = lead + b"".join(map(packer.compress, raw))
        assert list(warc.records(archive)) == raw
        for cut in (len(archive) - 1, len(lead) + 3, 6):
            with pytest.raises(ValueError):
                list(map(warc.parse, warc.records(archive[:cut])))
    good = raw[3]
    for bad in (good.replace(b"WARC/1.1", b"WARD/1.1"), good.replace(b"xxx", b"xyx", 1), good[:-2], good.replace(b"WARC-Date: ", b"WARC-Day: "), good.replace(b"Content-Length: 3000", b"Content-Length: 2999")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def level(sizes, weights, most=3):
    """Targets by sharing again and again."""
    left, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if share[i] > most * sizes[i]}
        for i in full or open_:
            target[i] = float(most * sizes[i]) if full else share[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def test_mix_targets_and_thresholds(spark):
    rows = [(i, "w " * (1 + i % 9), ["b", "a", "c", None, "ü"][(i % 31) // 8 if i % 31 < 30 else 4]) for i in range(1500)]
    rows.append((9999, None, "zero"))
    out = mixing.mix_sources(spark.createDataFrame([(i, t, s, 0, "h") for i, t, s in rows], "doc_id long, text string, source string, taken int, h string")).collect()
    order = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == x) for x in order]
    want = level(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))])
    source = {i: s for i, _, s in rows}
    for k, x in enumerate(order):
        mine = [r for r in out if source[r["doc_id"]] == x]
        assert all(math.isclose(r["target"], want[k], abs_tol=1e-6) and r["source_size"] == sizes[k] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[k]) <= 9
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)


def test_mix_edges(edge, nothing):
    rows = mixing.mix_sources(edge).collect()
    assert len(rows) == edge.count() and all(r["size"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mix_sources(nothing).count() == 0
    assert all(r["target"] == 0 for r in mixing.mix_sources(edge.where("doc_id in (1, 2, 3)")).collect())


def test_audio_alignment(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.125, 64).tolist(), "c") for i in range(60)]
    rows += [(100, rows[20][1], "c"), (20, rows[20][1], "c"), (120, None, "c"), (140, [0.1], "c"), (160, [None] * 64, "c"), (None, rows[0][1], "c")]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, codes string")
    out = chroma.search_clips(vectors).collect()
    by = {}
    for r in out:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == {0, 20, 40, 100, 120, 140, 160}
    for i in (0, 40):
        assert [(r["match_id"], r["offset"]) for r in by[i]] == [(i, 16)] and by[i][0]["bit_error"] < 0.05
    assert {r["match_id"] for r in by[20] + by[100]} == {20} and by[100][0]["n_copies"] == 3
    assert by[120][0]["match_id"] is None and by[140][0]["match_id"] is None
    assert chroma.search_clips(vectors.limit(0)).count() == 0


def test_wav_is_read_with_its_channels():
    left = (np.sin(np.arange(4000) / 5) * 9000).astype("<i2")
    assert np.allclose(chroma.samples_of(chroma.wav(left)), left)
    stereo = bytearray(chroma.wav(np.repeat(left, 2)))
    stereo[22] = 2
    assert np.allclose(chroma.samples_of(bytes(stereo)), left)
    assert len(chroma.samples_of(b"RIFFxxxxWAVE")) == len(chroma.samples_of(None)) == len(chroma.fingerprint(np.zeros(100))) == 0


def _aligned_by_brute_force(queries, items, voted):
    """(query, item) -> (offset, votes, frames) over all pairs and offsets that stand, with a vote if voted."""
    out = {}
    for i, q in queries:
        for k, c in items:
            stand = []
            for o in range(1 - len(q), len(c)):
                both = [(q[t], c[t + o]) for t in range(len(q)) if 0 <= t + o < len(c)]
                wrong, votes = sum((x ^ y).bit_count() for x, y in both) / max(1, 32 * len(both)), sum(x == y for x, y in both)
                if len(both) >= 8 and wrong <= 0.25 and (votes or not voted):
                    stand.append((-votes, wrong, o, len(both)))
            if stand:
                votes, _, o, frames = min(stand)
                out[i, k] = o, -votes, frames
    return out


def test_alignment_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [(k, [int(x) for x in rng.integers(0, 2**32, 60)]) for k in range(12)]
    motif = items[5][1][20:26]
    items[5] = (5, motif + items[5][1][6:])  # its motif stands at 0 and at 20

    def noisy(codes, error):
        return [c ^ int(sum(1 << b for b in np.flatnonzero(rng.random(32) < error))) for c in codes]

    queries = [(k, noisy(items[k][1][12:42], error)) for k, error in enumerate([0.0, 0.02, 0.05, 0.05, 0.05])]
    queries += [(5, motif + noisy(items[5][1][26:50], 0.1)), (6, [int(x) for x in rng.integers(0, 2**32, 30)])]
    # The wrong offset of this one has three equal codes in 30 frames, the true one two.
    c = items[7][1]
    fooled = noisy(c[12:42], 0.06)
    fooled = [x ^ 1 if x == y else x for x, y in zip(fooled, c[12:42])]
    fooled[0:2], fooled[10:13] = c[12:14], c[42:45]
    queries.append((7, fooled))
    frames = [spark.createDataFrame(rows, f"{key} long, codes array<bigint>") for key, rows in (("query", queries), ("item", items))]
    got = {(r["query"], r["item"]): (r["offset"], r["votes"], r["frames"]) for r in chroma.align(*frames).collect()}
    assert got == _aligned_by_brute_force(queries, items, True)
    assert set(_aligned_by_brute_force(queries, items, False)) == set(got) == {(k, k) for k in (0, 1, 2, 3, 4, 5, 7)}
    assert got[7, 7][:2] == (12, 2)


def test_clips_off_the_grid_are_found(spark):
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, rng.normal(0, 0.125, 64).tolist()) for i in range(0, 400)], "vec_id bigint, embedding array<float>")
    found = {(r["vec_id"], r["match_id"]) for r in chroma.search_clips(vectors).collect() if r["match_id"] is not None}
    rows = chroma._sounds(vectors).collect()
    every = _aligned_by_brute_force([(r["vec_id"], r["clip"][0]) for r in rows if r["clip"] is not None], [(r["vec_id"], r["codes"]) for r in rows if r["vec_id"] < 60], False)
    every = set(every) | set(_aligned_by_brute_force(*[[(r["vec_id"], (r[c][0] if c == "clip" else r[c])) for r in rows if r["vec_id"] % 20 == 0] for c in ("clip", "codes")], False))
    rough = {p for p in every if p[0] // 20 % 4 == 3}
    assert rough and len(every & found) >= 0.95 * len(every) and rough <= found


def test_thousands_of_url_rules_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    labels = [f"{a}{b}" for a in ("shop", "news", "mail", "cdn", "img") for b in range(60)]
    tops = ["com", "net", "org", "example.com"]
    hosts = [f"{rng.choice(labels)}.{rng.choice(tops)}" for _ in range(1200)]
    rules = sorted({(rng.choice(["allow", "block"]), h + "/" + rng.choice(["", "", "en/", "de/x", "a-b/"])) for h in hosts + tops for _ in range(3)}, key=lambda x: x[1])
    rules = [r for i, r in enumerate(rules) if not i or rules[i - 1][1] != r[1]]
    assert len(rules) > 2000
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'A.b.'])}{rng.choice(hosts)}/{rng.choice(['', 'en/', 'en', 'de/xyz', 'a-b/1', 'q?en/'])}" for _ in range(500)] + ["no url", None, "://com/", "ftp://x.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, urlfilter.rule_frame(spark, urlfilter.site_rules(rules))).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.lower()
        best = None
        for verdict, rule in rules:
            of, slash, start = rule.partition("/")
            if (host == of or host.endswith("." + of)) and path.startswith(slash + start) and (best is None or (len(rule), rule) > best[0]):
                best = (len(rule), rule), (rule, verdict)
        assert got[i] == (best[1] if best else (None, "allow")), url
