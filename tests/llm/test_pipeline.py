import corpus_pipeline as P
from pyspark.sql import functions as F

from flowguard.llm.shared import materialize


def test_stages_on_edges(spark, edge, nothing, sf_dir):
    base = edge.select("doc_id", "text", "lang", "source", "n_chars", "keys")
    for docs in (base, nothing.select(base.columns)):
        for name, stage in P.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir))
            assert docs.columns == base.columns, name
        assert P.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_stages_keep_what_they_should(spark, documents, sf_dir):
    kept = P.language(spark, documents, sf_dir)
    assert kept.count() >= 0.95 * documents.where("text is not null").count()
    lines = materialize(P.lines(spark, kept, sf_dir))
    one = materialize(P.near_duplicates(spark, lines, sf_dir))
    assert one.select("doc_id").distinct().count() == one.count() <= lines.count()
    mixed = materialize(P.mix(spark, one, sf_dir))
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = P.tokens(spark, mixed, sf_dir)
    assert out.count() == mixed.count() and out.where("n_tokens <> size(token_ids)").count() == 0


def test_stages_keep_clashing_columns_and_judge_rows_that_share_an_id(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "the cat and the dog ran away " + words, "en", "a", 0, 0.25, "x", 9, 8),
        (1, "der hund und die katze sind hier " + words.upper(), "de", "a", 0, 0.5, "y", 7, 6),
        (1, "the cat and the dog ran away " + words, "en", "a", 0, 0.25, "x", 9, 8),
        (2, "the cat and the dog ran away " + words + " end", "en", "b", 0, 0.75, "z", 5, 4),
        (None, "another text of its own that is about the weather and the sea", "en", None, 0, 1.5, "u", 3, 2),
        (None, "die andere seite des meeres und das wetter von gestern abend", "de", None, 0, 1.5, "v", 3, 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_lines int, n_removed int")
    known = {(r["score"], r["lang_pred"], r["n_lines"], r["n_removed"]) for r in docs.collect()}
    for stage in (P.language, P.lines, P.near_duplicates, P.mix):
        out = stage(spark, docs, "").collect()
        assert out and out[0].__fields__ == docs.columns
        assert {(r["score"], r["lang_pred"], r["n_lines"], r["n_removed"]) for r in out} <= known
    kept = P.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["lang"]) for r in kept) == [(0, "de"), (0, "en"), (1, "de"), (1, "en")]
    assert {r["lang_pred"] for r in kept} >= {"u", "v"}


def lines_left(rows, chars=7, percent=80):
    """(row, text left) by comparing every pair of lines; a short line is one shingle as a whole. rows in order of (doc_id, text)."""
    import re

    from test_near_duplicates import union_find

    places = []
    for n, text in enumerate(rows):
        for at, line in enumerate(text.split("\n")):
            shape = re.sub(r"\s+", " ", line).strip().lower()
            if shape:
                places.append((n, at, {shape[i : i + chars] for i in range(max(1, len(shape) - chars + 1))}))
    links = [(x, y) for x in range(len(places)) for y in range(x) if len(places[x][2] & places[y][2]) * 100 >= percent * len(places[x][2] | places[y][2])]
    first = union_find(range(len(places)), links)
    gone = {places[x][:2] for x, c in first.items() if x != c}
    return ["\n".join(line for at, line in enumerate(t.split("\n")) if (n, at) not in gone) for n, t in enumerate(rows)]


def test_run_equals_brute_force(spark, tmp_path):
    import random

    import tokenizers
    from test_near_duplicates import shingles, union_find

    from flowguard.llm import mixing, queries

    rng = random.Random(31)
    english = "the of and to in that was his with had which from their there would about other these could some".split()
    german = "der die und das nicht ein ist auch sich mit auf für dem wird eine noch nach über wenn durch".split()

    def line(words):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "en", "er"]) for _ in range(rng.randint(3, 14)))

    common, rows = [line(english) for _ in range(4)] + ["ok."], []
    for i in range(70):
        words, lang = (english, "en") if i % 2 else (german, "de")
        parts = [line(words) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(1, rng.choice(common) + rng.choice(["", "!"]))
        rows.append((i, "\n".join(parts), lang, rng.choice("abc"), 0))
    rows += [(100 + i, "\n".join(x + " " + line(english) for x in rows[i][1].split("\n")[:1]) + " " + rows[i][1].replace("\n", " "), rows[i][2], "a", 0) for i in range(0, 20)]
    rows += [(200, "12 34", "en", "a", 0), (201, None, "en", "b", 0), (202, "  ", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    kept = {r["doc_id"] for r in P.language(spark, docs, str(tmp_path)).collect()}
    assert {200, 201, 202}.isdisjoint(kept) and len(kept) >= 85
    rows = [r for r in rows if r[0] in kept]
    left = [(r[0], t, r[3]) for r, t in zip(rows, lines_left([r[1] for r in rows])) if t.strip() or t == r[1]]
    sets = [shingles(t, 5) for _, t, _ in left]
    links = [(x, y) for x in range(len(left)) for y in range(x) if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    first = union_find(range(len(left)), links)
    left = [r for i, r in enumerate(left) if first[i] == i]
    frame = spark.createDataFrame(left, "doc_id long, text string, source string")
    taken = mixing.mix_sources(frame.select(P._key().alias("doc_id"), "text", "source")).select("doc_id.doc_id", "size", "taken").collect()
    times = {r["doc_id"]: r["taken"] // r["size"] for r in taken}
    library = tokenizers.Tokenizer.from_file(queries.default_tokenizer())
    library.no_padding()
    library.no_truncation()
    want = []
    for i, text, source in left:
        ids = library.encode(text, add_special_tokens=False).ids
        want += [(i, source, len(ids), ids, library.decode(ids, skip_special_tokens=False))] * times[i]
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["source"], r["n_tokens"], r["token_ids"], r["decoded"])) for r in got)
