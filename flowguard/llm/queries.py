"""The registered queries of these operators: each applies one to its whole table, and some have an equal in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, fingerprints, langid, linedup, maintext, minhash, mixing, periodic, resampling, toxicity, urlfilter, warc


TOXIC_FROM = 0.7


def default_tokenizer() -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(documents, ~held_out)
    return langid.identify(documents, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlfilter.rule_frame(spark, urlfilter.site_rules(urlfilter.SITE_RULES) + urlfilter.label_rules(urlfilter.BAD_LABELS))
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    spec = bpe.read_spec(tokenizer or default_tokenizer())
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), spec).drop("text"), spec)
    return coded.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(bpe.joined(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search_clips(_table(spark, sf_dir, "embeddings"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85, bands=48, rows=8)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linedup.dedupe_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), linedup.CHARS, short=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _with_tails(doc_id: Column, text: Column) -> Column:
    """The text; for every tenth id by hash, with its words from a drawn place on made to repeat those that stand there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        head, tail = F.slice(words, F.lit(1), a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
        again = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(head, again), " "))

    made = F.element_at(F.transform(F.array(periodic.words_of(text)), repeated), 1)  # so that the words are made once
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.detect_runs(documents.withColumn("text", _with_tails(F.col("doc_id"), F.col("text"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    every = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_simhash, op2_language, op3_url_rules, op4_toxicity, op5_warc, op6_mix, op7_bpe, op8_chroma, op9_minhash, op10_line_dedup, op11_resample, op12_main_text, op13_periodic_runs, pipeline)
    return {f.__name__: f for f in every}


_UPPER = f"'{urlfilter._UPPER}', '{urlfilter._LOWER}'"
_SITES = ", ".join(f"({i}, '{verdict}', '{rule}')" for i, (verdict, rule) in enumerate(urlfilter.SITE_RULES))
_LABELS = ", ".join(f"('{x}')" for x in urlfilter.BAD_LABELS)

_OP3 = f"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest
), urls AS (
  SELECT page_id, translate(h, {_UPPER}) AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut
), sites(i, verdict, rule) AS (VALUES {_SITES}), labels(label) AS (VALUES {_LABELS}),
parts AS (SELECT *, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM sites)
SELECT page_id, host, path,
  (SELECT arg_max(rule, length(rule)) FROM parts WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rule)) FROM parts WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
    CASE WHEN EXISTS (SELECT 1 FROM labels WHERE list_contains(string_split(host, '.'), label)) THEN 'block' ELSE 'allow' END) AS verdict
FROM urls
"""

_OP5 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + strpos('0123456789abcdef', hex[i]) - 1), 4)), '') AS b FROM p
), coded AS (
  SELECT page_id, html, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_reduce(list_transform(range(1, 6), lambda k: CAST(b[5 * i + k] AS INT)), lambda x, y: 2 * x + y) AS INT)]), '') AS payload_digest FROM bits
), last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM coded)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM last
"""

_OP6 = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS lim FROM totals
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS lev
  FROM ranked WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, lev <= lim / weight AS open, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS k FROM levels
), targets AS (
  SELECT source, source_size, CAST(CASE WHEN open THEN weight * (SELECT arg_min(lev, k) FROM opened WHERE open) ELSE lim END AS DOUBLE) AS target FROM opened
), placed AS (
  SELECT doc_id, s.source, size, h, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS here
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND (upto <= target - whole * source_size
    OR (upto - here <= target - whole * source_size AND (target - whole * source_size - (upto - here)) * 2 > here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

_OP9 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, {_UPPER}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

_BYTES = "list_transform(range(0, CAST(octet_length(encode(w)) AS BIGINT)), lambda i: CAST(('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"

_OP11 = f"""
WITH crc AS (
  SELECT list(list_reduce(range(0, 8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), k) ORDER BY k) AS tab FROM range(0, 256) AS r(k)
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark
), words AS (
  SELECT side, row, unnest(regexp_extract_all(translate(text, {_UPPER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM texts
), hashed AS (
  SELECT w, xor(list_reduce({_BYTES}, lambda a, b: xor(tab[1 + (xor(a, b) & 255)], a >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), crc
), features AS (SELECT side, row, bucket FROM words JOIN hashed USING (w)),
counts AS (
  SELECT bucket, CAST(count(*) FILTER (side = 'd') AS DOUBLE) AS s, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS t FROM features GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counts
), weights AS (SELECT row, count(*) AS n_features, sum(gain) AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT row, doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'
), drawn AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score, n_features >= 20 AS fit FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS place, count(*) OVER (PARTITION BY fit) AS n FROM drawn
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": _OP3, "op5_warc": _OP5, "op6_mix": _OP6, "op9_minhash": _OP9, "op11_resample": _OP11}
