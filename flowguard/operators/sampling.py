"""Samples, splits and balancing. Every random choice is the order of md5(key|seed): the same in any partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowguard.functions.columns import fraction, key_order
from flowguard.sources.scratch import discard, written


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "flow_key") -> DataFrame:
    """Exactly min(n, rows) rows: a top-k, not a sort of the table."""
    return df.orderBy(key_order(F.col(key), seed), key).limit(n)


def shuffled(df: DataFrame, seed: int = 42, key: str = "flow_key") -> DataFrame:
    """All rows in random order; place, the row's hash, carries it."""
    return df.withColumn("place", key_order(F.col(key), seed)).orderBy("place", key)


def pool_caps(df: DataFrame, domain: str, attack: Column, normal_cap: int = 2000, attack_cap: int = 500, seed: int = 42, key: str = "flow_key") -> DataFrame:
    """At most so many normal and attack rows of each domain.

    Rows are counted by leading hash digits, and only those up to the digits within which a cap is reached are ranked: a task
    reads the cap and one bucket of 4,096.
    """
    kind = F.coalesce(attack == 1, F.lit(False))
    placed = df.withColumn("is_attack", attack).withColumn("_a", kind).withColumn("_h", key_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    cap = F.when(F.col("_a"), attack_cap).otherwise(normal_cap)
    counts = placed.groupBy(domain, "_a", "_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(domain, "_a").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("_before", before).where(F.col("_before") < cap).groupBy(F.col(domain).alias("_d"), F.col("_a").alias("_k")).agg(F.max("_b").alias("_last"))
    near = placed.join(F.broadcast(last), F.col(domain).eqNullSafe(F.col("_d")) & (F.col("_a") == F.col("_k"))).where(F.col("_b") <= F.col("_last"))
    place = F.row_number().over(W.partitionBy(domain, "_a").orderBy("_h", key))
    return near.withColumn("_place", place).where(F.col("_place") <= cap).drop("_a", "_h", "_b", "_d", "_k", "_last", "_place")


def split_stratified(df: DataFrame, label: str = "label", share: float = 0.2, seed: int = 42, key: str = "flow_key", names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """split: the first round(share * n) of each class by hash are names[0], the rest names[1].

    The cut is found by counting leading hash digits, then by ranking the one bucket that it falls into, so a class of
    any size is spread over tasks. Both read keys and labels only; whole rows are read once, against one cut a class.
    """
    placed = df.withColumn("_h", key_order(F.col(key), seed))
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    keys = placed.select(label, key, "_h", bucket.alias("_b"))
    counts = keys.groupBy(label, "_b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy(label).orderBy("_b"))
    total = F.sum("n").over(W.partitionBy(label))
    cuts = counts.select(label, "_b", (upto - F.col("n")).alias("_before"), upto.alias("_upto"), F.floor(total * share + 0.5).alias("_take"))
    edge = keys.join(F.broadcast(cuts.where("_before < _take AND _take <= _upto").drop("_upto")), [label, "_b"])
    by_hash = W.partitionBy(label, "_b").orderBy("_h", key)
    here = F.struct("_h", key)
    ranked = edge.withColumn("_place", F.row_number().over(by_hash) + F.col("_before")).withColumn("_tied", F.coalesce(F.lead(here).over(by_hash) == here, F.lit(False)))
    last = written(ranked.where("_place = _take").select(label, F.col("_h").alias("_cut"), F.col(key).alias("_cut_key"), "_tied"), "cuts")
    if not last.where("_tied").limit(1).count():
        rows = placed.where(F.col(label).isNotNull() & F.col("_h").isNotNull()).join(F.broadcast(last), label, "left")
        first = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col(key) <= F.col("_cut_key")))
        return rows.withColumn("split", F.when(first, names[0]).otherwise(names[1])).drop("_h", "_cut", "_cut_key", "_tied")
    # a key that stands on both sides of a cut: rows are told apart by their place
    rows = placed.withColumn("_b", bucket).join(F.broadcast(cuts), [label, "_b"])  # 4,096 rows for each class
    edge = (F.col("_before") < F.col("_take")) & (F.col("_take") < F.col("_upto"))
    place = F.row_number().over(by_hash)
    inside = rows.where(edge).withColumn("split", F.when(place + F.col("_before") <= F.col("_take"), names[0]).otherwise(names[1]))
    outside = rows.where(~edge).withColumn("split", F.when(F.col("_upto") <= F.col("_take"), names[0]).otherwise(names[1]))
    return inside.unionByName(outside).drop("_h", "_b", "_before", "_upto", "_take")


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ordered ranges _p, written, so that their numbers are stable."""
    return written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def split_tail(df: DataFrame, order: list[str], share: float = 0.2) -> DataFrame:
    """part: the last floor(share * n) rows in order are validation, the rest fit.

    The table is ranked by range: rows are dealt to ordered ranges, ranked inside, and moved by the ranges' running counts.
    """
    ranged = _ranged(df, order)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("_p", before.alias("_before"), F.sum("n").over(W.partitionBy()).alias("_total")))
    place = F.row_number().over(W.partitionBy("_p").orderBy(*order)) + F.col("_before")
    rows = ranged.join(counts, "_p").withColumn("place", place)
    cut = F.col("_total") - F.floor(F.col("_total") * share)
    return rows.withColumn("part", F.when(F.col("place") > cut, "validation").otherwise("fit")).drop("_p", "_before", "_total")


def mark_tail(df: DataFrame, order: list[str], share: float = 0.2) -> DataFrame:
    """split_tail without the place: only the order's columns are dealt and ranked, in the one range that the cut falls into,
    and whole rows are met with the last row before the cut."""
    ranged = _ranged(df.select(*order), order)
    sizes = sorted((r._p, r.n) for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row for each range
    total = sum(n for _, n in sizes)
    cut, before = total - int(total * share), 0
    if not total or cut == total:
        discard(ranged)
        return df.withColumn("part", F.lit("fit"))
    for part, n in sizes:
        if before + n >= cut:
            break
        before += n
    by_order, here = W.partitionBy("_p").orderBy(*order), F.struct(*order)
    ranked = ranged.where(F.col("_p") == part).withColumn("_place", F.row_number().over(by_order)).withColumn("_tied", F.coalesce(F.lead(here).over(by_order) == here, F.lit(False)))
    last = written(ranked.where(F.col("_place") == cut - before).select(here.alias("_last"), "_tied"), "cut")
    discard(ranged)
    if not last.where("NOT _tied").limit(1).count():  # equal rows on both sides of the cut, or no row before it
        discard(last)
        return split_tail(df, order, share).drop("place")
    return df.crossJoin(F.broadcast(last.select("_last"))).withColumn("part", F.when(here > F.col("_last"), "validation").otherwise("fit")).drop("_last")


#: Places in a block of neighbours() at most, children of a node of its tree, and asking places that meet a block in one group.
BLOCK, BITS, GROUP = 1000, 3, 4096
FAN = 1 << BITS


def _nearest(asking: np.ndarray, answering: np.ndarray, spots: list[str], keys: list[list[str]], k: int) -> list[tuple[str, float, str]]:
    """(spot, d, other): each asking place's k nearest points by (squared distance, key). keys: of the points at each answering place."""
    rows = []
    for first in range(0, len(asking), 512):
        some = asking[first : first + 512]
        square = np.zeros((len(some), len(answering)))
        for i in range(asking.shape[1]):
            square += (some[:, i, None] - answering[:, i]) * (some[:, i, None] - answering[:, i])
        last = min(k, len(answering)) - 1
        reach = np.partition(square, last, axis=1)[:, last : last + 1]
        for spot, d, near in zip(spots[first : first + 512], square, (square <= reach) | np.isnan(reach)):
            found = sorted((d[j], key) for j in np.flatnonzero(near) for key in keys[j])[:k]
            rows += [(spot, x, key) for x, key in found]
    return rows


def _gap(at: Column, low: Column, high: Column) -> Column:
    """Squared distance of a place from a box, in the order and rounding of _nearest: never more than that to a place inside."""
    beyond = F.zip_with(F.zip_with(low, at, lambda a, x: a - x), F.zip_with(at, high, lambda x, b: x - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(beyond, F.lit(0.0), lambda total, g: total + g * g)


def partition_tree(places: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(places with their block, nodes): places (at, ...) cut into blocks of at most BLOCK by quantiles, each block along the
    column in which its middle half is widest. A block's children are FAN block + 1 to FAN block + FAN.

    nodes: (node, parent, leaf, low, high), with the box of what lies below each. All blocks of a level are cut by one
    aggregation and one join. Places are distinct, so that every cut leaves something on both sides.
    """
    parts = [i / FAN for i in range(1, FAN)]
    placed = written(places.withColumn("block", F.lit(0).cast("long")).withColumn("done", F.lit(False)), "tree")
    while True:
        open_ = placed.where("NOT done")
        measured = open_.groupBy("block").agg(
            F.count("*").alias("n"), *[F.percentile_approx(F.col("at")[i], parts, 500).alias(f"q{i}") for i in range(width)], *[f(F.col("at")[i]).alias(f"{m}{i}") for i in range(width) for m, f in (("lo", F.min), ("hi", F.max))]
        )
        # by the spread of the middle half, or of all where that is nothing anywhere
        options = [F.struct((F.col(f"q{i}")[FAN * 3 // 4 - 1] - F.col(f"q{i}")[FAN // 4 - 1]).alias("half"), (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("all"), F.lit(i).alias("dim"), F.when(F.col(f"q{i}")[FAN * 3 // 4 - 1] > F.col(f"q{i}")[FAN // 4 - 1], F.array_distinct(f"q{i}")).otherwise(F.array(f"lo{i}")).alias("cuts")) for i in range(width)]
        splits = written(measured.select("block", "n", F.array_max(F.array(*options)).alias("s")).select("block", (F.col("n") > BLOCK).alias("large"), "s.dim", "s.cuts"), "splits")
        if not splits.where("large").limit(1).count():
            discard(splits)
            break
        moved = open_.join(_small(splits), "block")
        value = F.element_at("at", F.col("dim") + 1)
        child = F.col("block") * FAN + 1 + F.size(F.filter("cuts", lambda c: c < value))
        moved = moved.withColumn("block", F.when(F.col("large"), child).otherwise(F.col("block"))).withColumn("done", ~F.col("large")).drop("large", "dim", "cuts")
        before, placed = placed, written(moved.unionByName(placed.where("done")), "tree")
        discard(before, splits)
    sides = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)])
    leaves = placed.groupBy("block").agg(sides(F.min, "at").alias("low"), sides(F.max, "at").alias("high"))
    parent = lambda x: F.shiftright(x - 1, BITS)  # noqa: E731  -1 for the root
    line = [F.col("block")]
    for _ in range(60 // BITS):
        line.append(parent(line[-1]))
    above = leaves.select("block", "low", "high", F.explode(F.filter(F.array(*line), lambda x: x >= 0)).alias("node"))
    nodes = above.groupBy("node").agg(sides(F.min, "low").alias("low"), sides(F.max, "high").alias("high"), F.bool_and(F.col("block") == F.col("node")).alias("leaf"))
    return placed.drop("done"), written(nodes.withColumn("parent", parent(F.col("node"))), "nodes")


def _small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A written frame marked for broadcast if it has at most so many rows; otherwise the join is left to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def neighbours(points: DataFrame, columns: list[str], k: int = 5, key: str = "flow_key") -> DataFrame:
    """(key, others): the keys of each point's k nearest others by Euclidean distance, ties by key; exact at any size.

    Points of one place have the same list but for themselves, so places are compared, each with its k + 1 smallest keys. They
    are cut into the blocks of a partition tree. A place first looks in its own block, which bounds how far it needs to look
    further; then it goes down the tree, level by level, to the blocks whose box lies within that bound.
    """
    here = points.select(F.col(key).cast("string").alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("at"))
    # In two steps, so that no task sorts all points of one place.
    firsts = here
    for w in (W.partitionBy("at", F.pmod(F.xxhash64("key"), F.lit(64))), W.partitionBy("at")):
        firsts = firsts.withColumn("_i", F.row_number().over(w.orderBy("key"))).where(F.col("_i") <= k + 1).drop("_i")
    places = firsts.groupBy("at").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    placed, nodes = partition_tree(places.withColumn("spot", F.col("keys")[0]), len(columns))
    kind = "spot string, d double, other string"

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        at = np.stack(part["at"].to_numpy())
        return pd.DataFrame(_nearest(at, at, list(part["spot"]), list(part["keys"]), k + 1), columns=["spot", "d", "other"])

    def across(asking: pd.DataFrame, answering: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(np.stack(asking["at"].to_numpy()), np.stack(answering["at"].to_numpy()), list(asking["spot"]), list(answering["keys"]), k + 1) if len(asking) and len(answering) else []
        return pd.DataFrame(found, columns=["spot", "d", "other"])

    own = written(placed.groupBy("block").applyInPandas(inside, kind), "own")
    # A place with fewer than k + 1 points in its block has no bound yet.
    bounds = own.groupBy("spot").agg(F.when(F.count("*") > k, F.max("d")).otherwise(float("inf")).alias("bound"))
    asks = placed.select("spot", "at", F.col("block").alias("own")).join(bounds, "spot").withColumn("node", F.lit(0).cast("long"))
    asks, found, below = written(asks, "asks"), None, nodes.where("NOT leaf").limit(1).count()
    while below:
        down = asks.join(_small(nodes.withColumnRenamed("node", "child").withColumnRenamed("parent", "node")), "node").where(~(_gap(F.col("at"), F.col("low"), F.col("high")) > F.col("bound")) & (F.col("child") != F.col("own")))
        before, down = asks, written(down.select("spot", "at", "own", "bound", F.col("child").alias("node"), "leaf"), "asks")
        discard(before)
        met = down.where("leaf").select("spot", "at", F.col("node").alias("block"))
        found = met if found is None else found.unionByName(met)
        asks = down.where("NOT leaf").drop("leaf")
        below = asks.limit(1).count()
    every = own
    if found is not None:
        # a block that very many places ask is asked in groups
        groups = written(found.groupBy("block").agg(F.ceil(F.count("*") / GROUP).alias("groups")), "groups")
        left = found.join(_small(groups), "block").withColumn("group", F.pmod(F.xxhash64("spot"), F.col("groups"))).select("block", "group", "spot", "at")
        right = placed.select("block", "at", "keys").join(_small(groups), "block").select("block", "at", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
        every = own.unionAll(left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(across, kind))
    ranked = every.withColumn("_i", F.row_number().over(W.partitionBy("spot").orderBy("d", "other"))).where(F.col("_i") <= k + 1)
    lists = ranked.groupBy("spot").agg(F.sort_array(F.collect_list(F.struct("_i", "other"))).alias("l"))
    lists = written(placed.join(lists, "spot").select("at", F.col("l.other").alias("l")), "lists")
    return here.join(lists, "at").select(F.col("key").alias(key), F.slice(F.filter("l", lambda x: x != F.col("key")), 1, k).alias("others"))


def _ranks(points: DataFrame, key: str, seed: int) -> DataFrame:
    """(key, _rank): ranks by hash, by counts of leading hash digits and ranks inside; no task ranks all rows."""
    placed = points.select(key, key_order(F.col(key), seed).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    counts = placed.groupBy("_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("_b", before.alias("_before")))  # 4,096 rows
    return placed.join(counts, "_b").select(key, (F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) + F.col("_before")).alias("_rank"))


def smote(df: DataFrame, columns: list[str], label: str = "label", minority: int = 1, k: int = 5, seed: int = 42, key: str = "flow_key") -> DataFrame:
    """Synthetic minority rows (key, columns..., label) until both classes are equal in number.

    Row i starts from the minority point of rank i mod m by hash and goes a fraction u towards one of its k nearest
    minority points; u and the choice come from the hash of its own key, so reruns agree. A single minority point is its
    own neighbour. Without minority points there are no rows.
    """
    points = df.where(F.col(label) == minority).select(key, *columns)
    counts = df.agg(F.count_if(F.col(label) == minority).alias("m"), F.count_if(F.col(label) != minority).alias("rest"))
    near = neighbours(points, columns, k, key)
    rounds = _ranks(points, key, seed).crossJoin(F.broadcast(counts))
    need = F.greatest(F.col("rest") - F.col("m"), F.lit(0))
    times = F.floor(need / F.col("m")) + F.when(F.col("_rank") <= need % F.col("m"), 1).otherwise(0)
    made = rounds.join(near, key).withColumn("_i", F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    made = made.withColumn("new_key", F.concat_ws("~", key, "_i"))
    choice = (F.floor(fraction(F.col("new_key"), seed + 1) * F.size("others"))).cast("int")
    made = made.withColumn("other", F.coalesce(F.get("others", choice), F.col(key))).withColumn("_u", fraction(F.col("new_key"), seed + 2))
    start = points.select(F.col(key).alias("_k1"), *[F.col(c).alias(f"s_{c}") for c in columns])
    end = points.select(F.col(key).alias("_k2"), *[F.col(c).alias(f"e_{c}") for c in columns])
    rows = made.join(start, F.col(key) == F.col("_k1")).join(end, F.col("other") == F.col("_k2"))
    values = [(F.col(f"s_{c}") + F.col("_u") * (F.col(f"e_{c}") - F.col(f"s_{c}"))).alias(c) for c in columns]
    return rows.select(F.col("new_key").alias(key), *values, F.lit(minority).alias(label))


def inject_attacks(flows: DataFrame, k: int, name: str, seed: int = 42, key: str = "flow_key") -> DataFrame:
    """A back-test feed: min(k, pool) attack rows by hash with their type replaced by a name come first (priority 0), then the normal traffic (priority 1)."""
    column = next((c for c in ("type", "Label", "label") if c in flows.columns), "type")
    drawn = sample_n(flows.where("label = 1"), k, seed, key).withColumn(column, F.lit(name)).withColumn("priority", F.lit(0))
    return drawn.unionByName(flows.where("label = 0").withColumn("priority", F.lit(1)))
