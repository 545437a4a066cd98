"""Components, MinHash documents and fuzzy lines against brute force."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from flowguard.llm import components, linedup, minhash, queries


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == union_find({x for p in real for x in p}, real)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split(" ")
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
        out.append(" ".join(words))
    return out


def test_documents_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [t for _ in range(6) for t in variants(rng, " ".join(f"t{rng.randrange(3000)}" for _ in range(60)), 12, 4)]
    texts += [None, "", "  ", "a b", "A  B", "solo", texts[0].upper()]
    rows = list(enumerate(texts))
    for words, percent, lines in ((3, 85, 8), (5, 80, 6)):
        sets = [shingles(t, words) for t in texts]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        want = union_find(range(len(rows)), links)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        got = minhash.near_duplicates(frame, words, percent, 48, lines).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = {r[:4] for r in con.sql(f"select doc_id, n_shingles, component_id, kept from ({queries.oracle_sql()['op9_minhash']})").fetchall()}
    assert {tuple(r) for r in queries.op9_minhash(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect()} == want


def test_hot_buckets_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(components, "SAMPLE", 1)
    monkeypatch.setattr(components, "HOT", 3)
    rng = random.Random(3)
    rows = list(enumerate(variants(rng, " ".join(f"t{i}" for i in range(80)), 30, 2)))
    sets = [shingles(t, 3) for _, t in rows]
    links = [(i, j) for i in range(30) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 48, 8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == union_find(range(30), links)


def test_document_edges(edge, nothing):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_shingles"] == by[2][0]["n_shingles"] == by[3][0]["n_shingles"] == 0 and by[1][0]["kept"]
    assert {r["component_id"] for r in by[4] + by[5]} == {4} and not by[5][0]["kept"] and len(by[4]) == 2
    assert by[6][0]["n_shingles"] == 1 and all(r["kept"] for r in by[None])
    assert minhash.near_duplicates(nothing).count() == 0


def lines_brute(rows, chars, percent):
    """doc_id -> text left."""
    places = []
    for i, t in rows:
        for at, line in enumerate((t or "").split("\n")):
            shape = re.sub(r"\s+", " ", line).strip().lower()
            if len(shape) >= chars:
                places.append((i, at, {shape[j : j + chars] for j in range(len(shape) - chars + 1)}))
    links = [(x, y) for x in range(len(places)) for y in range(x) if len(places[x][2] & places[y][2]) * 100 >= percent * len(places[x][2] | places[y][2])]
    first = union_find(range(len(places)), links)
    gone = {(places[x][0], places[x][1]) for x, c in first.items() if x != c}
    return {i: None if t is None else "\n".join(line for at, line in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in rows}


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 90))) for _ in range(25)]

    def near(line):
        return "".join(rng.choice("xyz") if rng.random() < 0.01 else c for c in line)

    rows = [(i, "\n".join(near(rng.choice(pool)) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "}\n}\n}"), (63, pool[3].upper() + " \n\t" + pool[3])]
    got = linedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == lines_brute(rows, 8, 80)


def test_line_edges(edge, nothing):
    out = linedup.dedupe_lines(edge)
    assert out.columns == [*edge.columns, "n_lines", "n_removed"] and out.count() == edge.count()
    rows = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0
    assert rows[5]["text"] == "" and rows[5]["n_removed"] == 2 and rows[4]["n_removed"] == 0
    assert rows[3]["text"] == " \n\t " and len(rows[6]["text"]) == 300_000
    assert linedup.dedupe_lines(nothing).count() == 0


def test_line_query_keeps_a_first_line(spark, sf_dir):
    out = queries.op10_line_dedup(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.agg(F.sum("n_removed")).first()[0] > 0


def test_short_lines_lose_their_copies(spark, tmp_path):
    import corpus_pipeline

    long = "a line that is long enough to have shingles"
    rows = [(1, f"les.\n\n{long}\nab"), (2, "LES. \nabc\n\n"), (3, "ab"), (4, f"les.\n\n{long}\nab")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (4, 1), 3: (1, 1), 4: (4, 3)}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "abc\n\n"}


def test_lines_are_shingled_by_seven_characters(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(75)) for _ in range(6)]
    rows = [(2 * i, x, 0) for i, x in enumerate(lines)] + [(2 * i + 1, x[:37] + "#" + x[38:], 0) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()} == {i: i % 2 for i in range(12)}
    assert {r["doc_id"] for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()} == set(range(0, 12, 2))


def test_a_large_group_of_near_copies_around_the_limit(spark, monkeypatch):
    """500 copies of one text with some words replaced: about half are linked to each other, none may be lost, and pairs don't come up by the square."""
    rng = random.Random(21)
    base = " ".join(f"t{i}" for i in range(120))
    second = base.replace("t40 ", "u1 u2 u3 u4 u5 u6 u7 u8 ")
    rows = list(enumerate(variants(rng, base, 300, 12) + variants(rng, second, 200, 9)))
    sets = [shingles(t, 3) for _, t in rows]
    links = [(i, j) for i in range(500) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = union_find(range(500), links)
    assert 20 < len(set(want.values())) < 480
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(frame, 3, 85, 48, 8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want

    held = spark.createDataFrame([(i, sorted(hash(x) for x in s)) for i, s in enumerate(sets)], "node long, s array<bigint>")
    groups = held.select(F.lit(0).alias("g"), "node", F.col("node").alias("c"))
    sure, pairs = components.residual_pairs(groups, held, 85)
    proposed = {(r["a"], r["b"]) for r in sure.unionAll(pairs).collect()}
    assert union_find(range(500), [p for p in proposed if p in {(b, a) for a, b in links}]) == want
    assert pairs.count() < 0.1 * 500 * 499 / 2


def test_groups_without_a_common_centre(spark):
    """Sets of several unrelated families in one group: the centre is empty, and no link is lost either."""
    rng = random.Random(5)
    sets = []
    for f in range(8):
        base = [f * 1000 + i for i in range(40)]
        sets += [sorted({x if rng.random() > 0.06 else 100_000 + rng.randrange(10**6) for x in base}) for _ in range(12)]
    held = spark.createDataFrame(list(enumerate(sets)), "node long, s array<bigint>")
    groups = held.select(F.lit(0).alias("g"), "node", F.col("node").alias("c"))
    for percent in (80, 85):
        links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))}
        sure, pairs = components.residual_pairs(groups, held, percent)
        assert sure.count() == 0 and links <= {(r["a"], r["b"]) for r in pairs.collect()}


def test_lines_near_the_limit_are_found(spark):
    """Recall over hundreds of pairs at 0.8 to 0.85, for short and long lines."""
    rng = random.Random(12)
    rows, pairs = [], 0
    while pairs < 400:
        n = rng.choice([40, 70, 150, 400])
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip()
        b = list(a)
        for _ in range(max(1, n // 80)):
            at = rng.randrange(len(b))
            b[at:at] = rng.choice(["#", "##", "###", "#+#"])
        b = "".join(b)
        x, y = ({" ".join(t.split())[i : i + 7] for i in range(len(" ".join(t.split())) - 6)} for t in (a, b))
        if 80 * len(x | y) <= 100 * len(x & y) < 85 * len(x | y):
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    got = linedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"), 7, 80, short=True)
    found = got.where("doc_id % 2 = 1 and n_removed = 1").count()
    assert found >= 0.99 * pairs and got.where("doc_id % 2 = 0 and n_removed = 1").count() == 0


def test_small_groups_give_only_linked_pairs(spark):
    """In a group of up to PAIRED members shared residuals are counted pair by pair: no pair comes up that isn't linked, and none is lost."""
    rng = random.Random(31)
    base = list(range(200))
    sets = [sorted({x if rng.random() > 0.07 else 1000 + rng.randrange(10**6) for x in base}) for _ in range(90)]
    linked = {(i, j) for j in range(90) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert 50 < len(linked) < 3000
    held = spark.createDataFrame(list(enumerate(sets)), "node long, s array<bigint>")
    sure, pairs = components.residual_pairs(held.select(F.lit(0).alias("g"), "node", F.col("node").alias("c")), held, 80)
    sure, pairs = ({(r["a"], r["b"]) for r in x.collect()} for x in (sure, pairs))
    assert sure | pairs <= linked
    assert union_find(range(90), sure | pairs) == union_find(range(90), linked)


def test_union_find_runs_no_job_to_count_its_edges(spark):
    """On a chain of 41 nodes: 67 jobs when every step's edges were read once more to be counted, 51 now."""
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("union-find", "count")
    found = components.connected_components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("union-find"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs < 60 and {r.component for r in found.collect()} == {0}


def test_a_text_is_hashed_once_not_once_a_line(spark):
    """Beside posexplode the hash of the text was worked out for every line, the square of a long text's length."""
    lines = linedup.lines_of(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"), 7, 1)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(text" in plan and "xxhash64(text" not in plan[: plan.index("Generate")]


def test_sets_of_shingles_are_of_code_points(spark):
    """A line's set has as many elements as it has distinct shingles, in characters beyond 16 bits too; those that are too short have none."""
    rows = ["abcdefgabcdefg", "\U0001f600\U0001f601bcdef\U0001f600\U0001f601bcdef", "\u00e4\u4e2d" * 9, "abcdef", "\U0001f600" * 6, "x" * 50]
    frame = spark.createDataFrame(list(enumerate(rows)), "node long, s string").select("node", linedup.shingle_set(F.col("s"), 7).alias("x"))
    want = {i: len({t[j : j + 7] for j in range(len(t) - 6)}) for i, t in enumerate(rows)}
    assert {r.node: len(r.x or []) for r in frame.collect()} == want


def test_shuffles_of_the_signatures_go_before_the_search(spark, monkeypatch):
    """They are larger than the documents and stayed beside the search's own ones."""
    left = []

    def shuffles():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return [b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")]

    def search(members, real=linedup.live_members):
        until = time.time() + 5
        while shuffles() and time.time() < until:
            time.sleep(0.2)
        left.append(shuffles())
        return real(members)

    monkeypatch.setattr(linedup, "live_members", search)
    docs = spark.createDataFrame([(i, f"a line of some length {i // 2}\nanother line {i}") for i in range(40)], "doc_id long, text string")
    assert linedup.dedupe_lines(docs, 7, 80, short=True).count() == 40 and left == [[]]
