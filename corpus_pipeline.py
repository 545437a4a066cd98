"""A corpus pipeline of five stages over documents; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents, whatever others
there are and whatever they are called. Decisions belong to rows: where rows share a doc_id, each is judged by its own text.
A null doc_id sorts last, null texts have no words and no language, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import bpe, langid, linedup, minhash, mixing
from flowguard.llm.queries import default_tokenizer
from flowguard.llm.shared import discard, materialize

#: Least regression value of the winning language with which a document stays.
LEAST_SCORE = 0.3


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """docs with columns of these names called otherwise, and what selects them under their own names again."""
    new = {c: c for c in docs.columns}
    for c in {*names} & {*docs.columns}:
        while new[c] in (*names, *docs.columns):
            new[c] = "_" + new[c]
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(f"`{n}`").alias(c) for c, n in new.items()]


def _key() -> Column:
    """What tells rows apart: the id, nulls last, and 128 bits of the text. Rows equal in it are interchangeable."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language. The model learns from the languages stated in docs; texts without a letter, and
    those that no language wins with LEAST_SCORE, go. Every row is judged by its own text, however long; equal rows alike."""
    docs, back = _aside(docs, ("lang_pred", "score"))
    model = langid.train(docs, F.lit(True))
    judged = langid.identify(docs, model, docs.columns)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of like lines; a document all of whose lines have gone goes too. n_chars follows the text that is left."""
    docs, back = _aside(docs, ("n_lines", "n_removed"))
    kept = linedup.dedupe_lines(docs, linedup.CHARS, short=True)
    blank = F.trim(F.regexp_replace("text", "\\s+", " ")) == ""
    left = kept.where((F.col("n_removed") == 0) | ~blank)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Of a group the row
    with the smallest doc_id stays, then the smallest hash of its text; of rows equal in both, one. Texts without words are like no other."""
    found = minhash.near_duplicates(docs.select(_key().alias("doc_id"), "text")).where("kept")
    kept = materialize(found.groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("equal")))
    left = docs.select(F.struct("*").alias("_row"), _key().alias("key")).join(kept, "key")
    one = left.where("equal = 1").select("_row")
    if kept.where("equal > 1").limit(1).count():
        one = one.unionAll(left.where("equal > 1").groupBy("key").agg(F.first("_row").alias("_row")).select("_row"))
    return one.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a document that the mix takes several times is so many rows, one that it
    doesn't take goes, as does one without words. A null source is one of its own."""
    taken = mixing.mix_sources(docs.select(_key().alias("doc_id"), "text", "source")).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("key")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("times"))
    rows = docs.select(F.struct("*").alias("_row"), _key().alias("key")).join(taken, "key")
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again")).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again: doc_id, source, n_tokens, token_ids, decoded. A null text is an empty one; other columns are left out."""
    spec = bpe.read_spec(default_tokenizer())
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), spec).drop("text"), spec)
    return coded.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: Language identification can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
