from pyspark.sql import functions as F

from flowguard.llm import langid, queries, toxicity


def test_language_accuracy_on_held_out_rows(spark, sf_dir, documents):
    out = queries.op2_language(spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id")
    found = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert found[1] > 20 and found[0] > 0.9
    assert out.where("score < 0 or score > 1").count() == 0 and out.count() == documents.count()


def test_language_edges(edge, nothing):
    model = langid.train(edge, F.lit(True), rows=50, landmarks=5)
    rows = {r["doc_id"]: r for r in langid.identify(edge, model, ["doc_id", "size"]).where("doc_id is not null").collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0.0 for i in (1, 2, 3, 8))
    assert rows[6]["lang_pred"] in model.languages
    assert langid.identify(nothing, model, ["doc_id"]).count() == 0
    assert langid.train(nothing, F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(edge, None, ["doc_id"]).collect()} == {"und"}


def test_kernel_scores_equal_the_definition():
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog ran off", "die maus und das haus"] * 3
    model = langid.fit(texts, ["en", "de"] * 6, landmarks=4)
    assert [model.languages[i] for i in model.scores(["the cat ran", "und die maus"]).argmax(1)] == ["en", "de"]


def test_planted_toxic_words_are_found(spark):
    import random

    rng = random.Random(4)
    common = ["".join(rng.choice(["th", "er", "an", "in", "on"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["zorkblat", "quimfudge", "vexnard"]

    def text(toxic):
        words = [rng.choice(common) for _ in range(80)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(80), rng.choice(bad) + rng.choice(["", "s", "er"]))
        return " ".join(words)

    labels = [i % 4 == 0 for i in range(600)]
    texts = [text(x) for x in labels]
    model = toxicity.fit(texts[:450], list(map(int, labels[:450])))
    meter = toxicity._Meter(model.given)
    import numpy as np

    got = model.score(np.array([meter.features(t) for t in texts[450:]])) >= 0.7
    assert np.mean(got == np.array(labels[450:])) > 0.95


def test_toxicity_query_and_edges(spark, sf_dir, edge, nothing, documents):
    out = queries.op4_toxicity(spark, sf_dir)
    assert out.count() == documents.count() and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (8, 0), (9, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(edge, labels, F.lit(True))
    rows = toxicity.score(edge, model)
    assert rows.count() == edge.count() and rows.where("score is null").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    assert {r["score"] for r in toxicity.score(edge, None).collect()} == {0.0}


def kernel_brute_force(texts, languages, marks, asked, ridge=0.05):
    """Scores by the definition: sets of n-grams, the kernel matrix, Nyström features and ridge regression."""
    import numpy as np

    def grams(text):
        s = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    sets, chosen = [grams(t) for t in texts], [grams(texts[i]) for i in marks]
    # What no landmark has is outside the model: it counts in a text's norm alone.
    k = np.array([[kernel(x, m) for m in chosen] for x in sets])
    w = k[marks]
    values, vectors = np.linalg.eigh(w + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    names = sorted(set(languages))
    y = np.array([[float(a == b) for b in names] for a in languages])
    z = k @ root
    beta = np.linalg.solve(z.T @ z + ridge * len(texts) / 100 * np.eye(z.shape[1]), z.T @ (y - y.mean(0)))
    return np.array([[kernel(grams(t), m) for m in chosen] for t in asked]) @ root @ beta + y.mean(0)


def test_kernel_scores_equal_brute_force():
    import numpy as np

    texts = ["the cat sat on the mat", "Der Hund und die Katze", "the dog ran off", "die Maus, und das Haus"] * 3 + ["кошка и собака", "мышь и дом"]
    languages = ["en", "de"] * 6 + ["ru", "ru"]
    asked = ["the cat ran", "und die Maus", "дом и кошка", "漢字 only", "x"]
    model = langid.fit(texts, languages, landmarks=14)
    assert np.abs(model.scores(asked) - kernel_brute_force(texts, languages, list(range(14)), asked)).max() < 1e-3
    few = langid.fit(texts, languages, landmarks=5)
    marks = np.unique(np.linspace(0, 13, 5).astype(int)).tolist()
    assert np.abs(few.scores(asked) - kernel_brute_force(texts, languages, marks, asked)).max() < 1e-3


def test_every_language_is_learnt(spark):
    import random

    rng = random.Random(2)
    names = [f"l{i:03d}" for i in range(250)]
    words = {n: ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(2)) for _ in range(12)] for n in names}
    rows = [(i, " ".join(rng.choice(words[n]) for _ in range(12)), n) for i, n in enumerate(n for n in names for _ in range(4))]
    rows += [(9000 + i, "toujours le même texte, mot pour mot", "fr") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True), rows=500)
    assert model.languages == sorted([*names, "fr"])
    asked = spark.createDataFrame([(n, " ".join(rng.choice(words[n]) for _ in range(12))) for n in names[::10]], "doc_id string, text string")
    got = langid.identify(asked, model, ["doc_id"]).collect()
    assert sum(r["doc_id"] == r["lang_pred"] for r in got) >= 23


def test_toxicity_reads_all_of_a_long_text(spark):
    import numpy as np

    texts = [" ".join(["plain", "words", "here", f"n{i % 7}", "zorkblat"] if i % 4 == 0 else ["plain", "words", "here", f"n{i % 7}"]) for i in range(300)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(300)])
    meter = toxicity._Meter(model.given)
    long = "plain words here " * 40_000
    got = model.score(np.array([meter.features(t) for t in (long, long + "zorkblat", "y" * 300_000)]))
    assert got[0] < 0.5 < got[1] and got[2] < 0.7


def _phrase_texts(n, seed):
    """Every fourth text has two ordinary words side by side which the others have apart."""
    import random

    vocabulary, rng = random.Random(1), random.Random(seed)
    common = ["".join(vocabulary.choice(["th", "er", "an", "in", "on", "lo", "ki"]) for _ in range(vocabulary.randint(1, 4))) for _ in range(400)]
    texts = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(80)]
        if i % 4 == 0:
            at = rng.randrange(80)
            words[at:at] = ["silver", "tiger"]
        else:
            words[20:20], words[60:60] = ["silver"], ["tiger"]
        texts.append(" ".join(words))
    return texts, [int(i % 4 == 0) for i in range(n)]


def test_toxic_phrases_of_ordinary_words_are_found():
    import numpy as np

    model = toxicity.fit(*_phrase_texts(1200, 1))
    texts, toxic = _phrase_texts(300, 2)
    meter = toxicity._Meter(model.given)
    got = model.score(np.array([meter.features(t) for t in texts])) >= 0.7
    assert np.mean(got == np.array(toxic, bool)) > 0.95


def test_toxicity_features_and_scores_equal_the_definition():
    """Every window compressed with both dictionaries by itself, nothing kept, hits counted one by one."""
    import math
    import re
    import zlib

    import numpy as np
    import zstandard

    texts, toxic = _phrase_texts(400, 3)
    texts = [t + " zorkblat zorkblats" if y else t for t, y in zip(texts, toxic)]
    model = toxicity.fit(texts, toxic)

    def length(window, dictionary):
        given = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    def saving(word, width, pair):
        padded = f" {word} "
        codes = [zlib.crc32(padded[i : i + width].encode()).to_bytes(4, "little") for i in range(max(1, len(padded) - width + 1))]
        starts = range(0, max(1, len(codes) - 32 + 16), 16)
        return max(length(b"".join(codes[i : i + 32]), pair[1]) - length(b"".join(codes[i : i + 32]), pair[0]) for i in starts)

    hit_by = dict(zip(model.given.phrases.tolist(), model.given.hits.tolist()))
    meter = toxicity._Meter(model.given)
    for text in [*texts[:6], "silver tiger", "Zorkblat! silver-tiger " + "q" * 300, "x"]:
        running = re.findall(r"[^\W\d_]+", text.lower())
        by_word = sorted((saving(w, 3, model.given.words) for w in set(running)), reverse=True)
        stems = [saving(w, 6, model.given.stems) for w in running]
        pairs = {zlib.crc32(a.encode()) << 32 | zlib.crc32(b.encode()) for a, b in zip(running, running[1:])}
        hits = [sum(hit_by.get(p, [0] * 4)[i] for p in pairs) for i in range(4)]
        n = len(stems)
        want = [by_word[0], sum(by_word[:2]) / len(by_word[:2]), *[sum(v >= x for v in by_word) for x in range(4, 25)], len(by_word)]
        want += [sum(max(v, 0) for v in stems) / n, *[sum(v >= x for v in stems) / n for x in (4, 8, 12, 16, 20)], *hits]
        got = meter.features(text)
        assert np.allclose(got, want)
        a, b, c = model.limits
        word_hits, different, phrase_hits = math.log1p(want[2 + a]), math.log1p(want[23]), math.log1p(hits[c])
        x = [want[0] / 10, want[1] / 10, word_hits, word_hits - different / 4, want[24], math.log1p(100 * want[25 + b]), phrase_hits, phrase_hits - different / 4]
        logit = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights)) + model.bias
        assert abs(model.score(got[None])[0] - 1 / (1 + math.exp(-logit))) < 1e-9


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    texts = [(i, ("zorkblat " if i % 2 else "") + f"plain words here {i} " * 20) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, "long " * 2_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i, _ in texts], (1000, 1)], "doc_id long, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: taken.append(texts))
    toxicity.train(docs, labels, F.lit(True), most_bytes=40_000)
    toxicity.train(docs, labels, F.lit(True))
    assert 20_000 < sum(map(len, taken[0])) < 60_000 and len(taken[1]) == 400


def test_folded_weights_and_landmarks_give_the_same_scores(monkeypatch):
    import numpy as np

    texts = ["the cat sat on the mat", "Der Hund und die Katze", "the dog ran off", "die Maus, und das Haus"] * 5
    asked = ["the cat ran", "und die Maus", "漢字 only", "x", ""]
    folded = langid.fit(texts, ["en", "de"] * 10, landmarks=9)
    monkeypatch.setattr(langid, "MOST_WEIGHTS", 0)
    plain = langid.fit(texts, ["en", "de"] * 10, landmarks=9)
    assert folded.weights is not None and plain.weights is None
    assert np.abs(folded.scores(asked) - plain.scores(asked)).max() < 1e-5


def test_many_languages_of_a_large_script_fit_in_bounded_memory():
    import pickle
    import random
    import tracemalloc

    rng = random.Random(5)
    names = [f"l{i:03d}" for i in range(300)]
    words = {n: ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(2)) for _ in range(120)] for n in names}
    texts, languages = zip(*[(" ".join(rng.choice(words[n]) for _ in range(150)), n) for n in names for _ in range(8)])
    langid._letters()
    tracemalloc.start()
    model = langid.fit(list(texts), list(languages), 600)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and len(pickle.dumps(model)) < 100 << 20
    asked = [" ".join(rng.choice(words[n]) for _ in range(40)) for n in names]
    right = [model.languages[i] == n for i, n in zip(model.scores(asked).argmax(1), names)]
    assert sum(right) > 290


def test_language_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 50, "en" if i % 3 else "de") for i in range(600)], "doc_id long, text string, lang string")
    few = langid.training_rows(docs, F.lit(True), most_bytes=60_000)
    assert 30_000 < sum(len(t) for t, _ in few) < 100_000 and {lang for _, lang in few} == {"de", "en"}
    assert len(langid.training_rows(docs, F.lit(True))) == 600
