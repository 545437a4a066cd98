"""Mixing sources to target weights by hash thresholds, with DataFrame functions alone.

A document's place in its source is a hash of its id. Words are summed by source and leading hash digits; the running sums
show in which bucket a source's budget ends, and only that bucket is summed again by further digits. A document is taken
if its hash lies below the threshold found. Nothing is sorted, and a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, small

MOST_SOURCES = 50_000
_DIGITS, _LEVELS = 3, 4


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and U+0009 to U+000D; 0 for null."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.size(parts) - ends, F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, known, source_size, target) from (source, known, source_size), one row for each source.

    Sources in the order of their code points, null last, get the weights in turn. All sizes together are shared by
    weight; a target stops at `most` times its source's size, and what is over is shared among the others by weight until
    no target is above. That end is one water level: source i has min(weight * level, most * size), and sources reach
    their limits in the order of limit / weight.
    """
    order = W.orderBy(F.col("known").desc(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * most)
    rising = W.orderBy(F.col("limit") / F.col("weight"), F.col("known").desc(), F.col("source"))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # A source is below its limit once the level that is left for it and all later ones is under its own ratio.
    ranked = ranked.withColumn("left", level).withColumn("open", F.col("left") <= F.col("limit") / F.col("weight"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("known").cast("int").alias("k"), F.col("source"), F.col("left")))).over(every)
    ranked = ranked.withColumn("level", first["left"])
    return ranked.select("source", "known", "source_size", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("limit")).cast("double").alias("target"))


def _digits(level: int) -> Column:
    """The hash digits of one level as a number."""
    return F.conv(F.substring("h", level * _DIGITS + 1, _DIGITS), 16, 10).cast("int")


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of documents (doc_id, text, source, ...).

    size counts words, taken how many of them the mix takes, repeats counted: every document of a source floor(target /
    source_size) times, and once more if its hash is below the source's threshold, the one whose sum is nearest to the
    target. Documents with the same id and source share a hash and go together. A null text has size 0, a null
    source is a source of its own, a null doc_id hashes as the empty text. If all sizes are 0, so are targets. The hash
    is md5 of seed and id, so reruns agree. Extra columns are not read. An empty table gives none.
    """
    key = F.coalesce(F.col("source"), F.lit(""))
    sized = documents.select(
        "doc_id", key.alias("source"), F.col("source").isNotNull().alias("known"), word_count(F.col("text")).alias("size"),
        F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, _DIGITS * _LEVELS).alias("h"),
    )
    sized = materialize(sized)
    totals = sized.groupBy("source", "known").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.withColumn("whole", whole)
    budgets = budgets.select("source", "known", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit("").alias("prefix"))
    for level in range(_LEVELS):
        at_end = budgets.select("source", "known", "prefix", "rest").where("rest > 0")
        here = sized.join(small(at_end, MOST_SOURCES), ["source", "known"]).where(F.substring("h", 1, level * _DIGITS) == F.col("prefix"))
        sums = here.groupBy("source", "known", _digits(level).alias("digit")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        running = W.partitionBy("source", "known").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(running))
        # The boundary bucket is the first whose running sum exceeds what is left; without one all documents are taken.
        edge = F.min(F.struct("digit", "words", (F.col("upto") - F.col("words")).alias("below")))
        over = sums.where("upto > rest").groupBy("source", "known").agg(edge.alias("edge")).select("source", "known", "edge.*")
        budgets = budgets.join(over, ["source", "known"], "left")
        end = F.concat("prefix", F.lower(F.lpad(F.conv(F.col("digit").cast("string"), 10, 16), _DIGITS, "0")))
        if level == _LEVELS - 1:
            # What is left at the end is one hash: its documents are taken if that comes nearer to the target.
            end = F.when((F.col("rest") - F.col("below")) * 2 > F.col("words"), F.concat(end, F.lit("g"))).otherwise(end)
        budgets = budgets.select(
            "source", "known", "source_size", "target", "whole",
            F.when(F.col("digit").isNotNull(), F.col("rest") - F.col("below")).otherwise(F.lit(0.0)).alias("rest"),
            F.when(F.col("rest") <= 0, F.col("prefix")).when(F.col("digit").isNull(), F.concat("prefix", F.lit("g"))).otherwise(end).alias("prefix"),
        )
        budgets = materialize(budgets)
    limits = budgets.select("source", "known", "source_size", "target", "whole", F.col("prefix").alias("limit"))
    out = sized.join(small(limits, MOST_SOURCES), ["source", "known"])
    taken = F.col("size") * (F.col("whole") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
