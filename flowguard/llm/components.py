"""Distributed union-find, and the search for linked pairs among rows that share buckets. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, materialize, small


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges, written, with their number and a hash of all of them, which the job that writes them takes along."""
    seen = Observation()
    out = materialize(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return out, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): for every node of a link the smallest node it reaches.

    Large-star and small-star steps alternate until the edges are stars. A step keeps one smallest neighbour for each
    node, never its list of neighbours, so a hub with any number of links stays a row. Rows with a null end or a = b
    link nothing; repeated edges count once; no edges give no rows.
    """
    edges, state = _written(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a")
        star = star.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        done, before = edges, state
        edges, state = _written(star.select("e.a", "e.b").where("a != b").distinct())
        discard(done, shuffles=False)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b"), F.col("b"))).distinct()


def _pair(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, spread: Callable[[Column], Column]) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, written.

    The verdict is written as a column and read back: a filter on it would have the optimizer spread the sets anew wherever the condition reads them.
    """
    one = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", spread(F.col("sa")).alias("x"), spread(F.col("sb")).alias("y"))
    m, n = F.size("x"), F.size("y")
    near = F.least(m, n) * 100 >= F.greatest(m, n) * percent
    linked = F.when(near, F.size(F.array_intersect("x", "y")) * (100 + percent) >= (m + n) * percent).otherwise(False)
    judged = materialize(both.select("a", "b", linked.alias("linked")))
    out = judged.where("linked").select("a", "b")
    out._written_to = judged._written_to
    return out


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the links are taken between components, so that most of them fall away at once."""
    ends = links
    for x in ("a", "b"):
        of = components.select(F.col("node").alias(x), F.col("component").alias("c"))
        ends = ends.join(of, x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    joined = connected_components(ends.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("c"))
    moved = components.join(joined, "component", "left").select("node", F.coalesce("c", "component").alias("component"))
    fresh = joined.select(F.col("component").alias("node"), F.col("c").alias("component")).join(components, "node", "left_anti")
    return materialize(moved.unionAll(fresh))


#: One node in SAMPLE shows which buckets are hot: those with HOT sampled members, some thousands in all.
SAMPLE, HOT, MOST_HOT = 64, 64, 50_000
#: So many nodes, some 40 bytes each, may be broadcast.
MOST_NODES = 400_000
#: In buckets of so many members every pair is compared: a fixed number for each. Larger ones are searched by residuals.
FEW = 12
#: In groups of so many members residuals are compared pair by pair: a fixed number for each. Larger ones are searched by prefixes.
PAIRED = 256
#: So many groups' centres, some kilobytes each, may be broadcast.
MOST_GROUPS = 2_000


def live_members(members: DataFrame) -> DataFrame:
    """(bucket, node, lo, mid) of the members that aren't alone in their bucket, with two members to compare with, in small buckets one.

    Most buckets have one or a few members: their rows are sent to one place and looked at there. Hot buckets are found
    beforehand and go another way, by partial aggregates and a join that splits large keys.
    """
    by_hash = F.struct(F.xxhash64("node").alias("h"), "node")
    sampled = members.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).groupBy("bucket").count()
    hot = materialize(sampled.where(F.col("count") >= HOT).select("bucket"))
    some = hot.limit(1).count() > 0
    w = W.partitionBy("bucket")
    cold = members.join(small(hot, MOST_HOT), "bucket", "left_anti") if some else members
    cold = cold.withColumn("k", F.count("*").over(w)).where("k > 1")
    lo = F.min("node").over(w)
    live = cold.select("bucket", "node", lo.alias("lo"), F.when(F.col("k") > FEW, F.min(by_hash).over(w)["node"]).otherwise(lo).alias("mid"))
    if some:
        warm = members.join(small(hot, MOST_HOT), "bucket")
        heads = warm.groupBy("bucket").agg(F.min("node").alias("lo"), F.min(by_hash).alias("mid"))
        live = live.unionAll(warm.join(heads, "bucket").select("bucket", "node", "lo", F.col("mid.node").alias("mid")))
    out = materialize(live)
    discard(hot)
    return out


def _unsettled(live: DataFrame, components: DataFrame) -> DataFrame:
    """(bucket, node, c, main, k) of the buckets that lie in several components: a member's component, the bucket's largest one, its number of members."""
    placed = live.select("bucket", "node").join(components, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    placed = materialize(placed)
    counts = placed.groupBy("bucket", "c").count()
    main = counts.groupBy("bucket").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("k"), F.count("*").alias("parts"))
    out = materialize(placed.join(main.where("parts > 1").drop("parts"), "bucket"))
    discard(placed)
    return out


def _second_heads(split: DataFrame) -> DataFrame:
    """Pairs (a, b): members outside a bucket's main component with two of their own kind, so that a second group in a bucket becomes a component too."""
    rest = split.where("c != main and k > %d" % FEW)
    heads = rest.groupBy("bucket").agg(F.min("node").alias("lo"), F.min(F.struct(F.xxhash64("node"), "node")).alias("mid"))
    pairs = rest.join(heads, "bucket").select("node", F.explode(F.array("lo", "mid.node")).alias("x"))
    return pairs.where("node != x").select(*_pair("node", "x")).distinct()


def _few(split: DataFrame) -> DataFrame:
    """Every pair of two components in a small bucket."""
    one = split.where("k <= %d" % FEW)
    two = one.select("bucket", F.col("node").alias("y"), F.col("c").alias("d"))
    return one.join(two, "bucket").where("node < y and c != d").select(*_pair("node", "y")).distinct()


def residual_pairs(groups: DataFrame, sets: DataFrame, percent: int, spread: Callable[[Column], Column] = lambda s: s) -> tuple[DataFrame, DataFrame]:
    """(sure, candidates), both (a, b): links of a group that need no comparison, and the pairs that may be linked besides.

    groups (g, node, c): c is the component of the node so far. Elements are bigint. A group's centre p has the elements that more than half of its members have.
    A member x is kept as its residual against p: the r elements of p that it lacks and the a elements that it has
    besides. For two members with o residual elements in common, and w = 100 r + percent a,

        linked  <=>  (100 + percent) o >= w_x + w_y - (100 - percent) |p|.

    If the right side isn't above 0 the pair is linked for sure, and both are then linked with the member m of the
    smallest w; sure has these links with m. All other linked pairs share o > 0 residual elements, at least as many as
    the bound says. In a group of up to PAIRED members o is counted for every pair, so that a member's residual is
    sent once and candidates are the linked pairs themselves. In larger ones candidates come from an equi-join on
    prefixes of the residuals, rarest element of the group first: of d elements the first d - t + 1, when t are to be
    shared. As t depends on both weights, weights fall into classes of a tenth, and a member has a prefix for each class
    that can hold a partner. Near copies of one text have few residual elements and their own ones come first, so a large
    group hardly ever gives candidates that don't share a change of the text.
    """
    limit, step, per = 100 - percent, math.log(1.1), 100 + percent
    held = groups.join(sets, "node")
    values = spread(F.col("s"))  # many times as long as what it is made from: made where it is read
    counts = held.select("g", F.explode(values).alias("e")).groupBy("g", "e").agg(F.count("*").alias("f"))
    of = groups.groupBy("g").agg(F.count("*").alias("k"))
    centre = counts.join(of, "g").where("2 * f > k").groupBy("g").agg(F.collect_list("e").alias("p"))
    rest = held.join(small(materialize(centre), MOST_GROUPS), "g", "left").withColumn("p", F.coalesce("p", F.array().cast("array<bigint>"))).withColumn("s", values)
    rest = rest.select("g", "node", "c", F.array_except("p", "s").alias("r"), F.array_except("s", "p").alias("x"), (F.size("p") * limit).cast("long").alias("sure"))
    base = materialize(rest.select("g", "node", "c", "sure", (F.size("r") * 100 + F.size("x") * percent).cast("long").alias("w"), F.concat("r", "x").alias("e")))
    least = materialize(base.groupBy("g").agg(F.min(F.struct("w", "node")).alias("m"), F.count("*").alias("k")))
    large = least.where(F.col("k") > PAIRED).limit(1).count() > 0
    rest = base.join(small(least, 20 * MOST_GROUPS), "g").withColumn("core", F.col("w") + F.col("m.w") <= F.col("sure"))
    sure = rest.where(F.col("core") & (F.col("node") != F.col("m.node"))).select(*_pair("node", "m.node"))
    sure = materialize(sure)
    paired = rest.where(F.col("k") <= PAIRED).select("g", "node", "c", "w", "sure", "core", "e")
    second = paired.select("g", *[F.col(x).alias(f"{x}_y") for x in ("node", "c", "w", "core", "e")])
    apart = "node < node_y and c != c_y and not (core and core_y)"
    bound = F.col("w") + F.col("w_y") - F.col("sure")
    shared = (F.least(F.size("e"), F.size("e_y")) * per >= bound) & (F.size(F.array_intersect("e", "e_y")) * per >= bound)
    near = paired.join(second, "g").where(apart).where(shared).select(*_pair("node", "node_y"))
    rest = rest.where(F.col("k") > PAIRED)

    def kind(w: Column) -> Column:
        return F.floor(F.log(F.greatest(w, F.lit(0)) + F.col("sure") + 1) / F.lit(step)).cast("int")

    w, d, limit_w = F.col("w"), F.size("e"), F.col("sure")
    # A core member needs partners outside the core only; a partner's weight has both bounds from the number it can share.
    lowest = F.greatest(F.floor((w - limit_w) * percent / 100), F.when(F.col("core"), limit_w - F.col("m.w") + 1).otherwise(0)).cast("long")
    highest = d * per + limit_w - w
    items = rest.select("g", "node", F.explode("e").alias("e"))
    often = items.groupBy("g", "e").agg(F.count("*").alias("f"))
    ordered = items.join(often, ["g", "e"]).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("order"))
    wide = rest.where((d > 0) & (highest >= lowest)).select("g", "node", "c", "w", "sure", "core", d.alias("d"), kind(lowest).alias("from"), kind(highest).alias("to"), kind(w).alias("own"))
    wide = wide.join(ordered, ["g", "node"])
    wide = wide.withColumn("other", F.explode(F.expr("sequence(`from`, greatest(`from`, `to`))")))
    floor_w = F.greatest(F.lit(0), F.floor(F.exp(F.col("other") * F.lit(step)) * (1 - 1e-9)) - limit_w - 1)
    t = F.greatest(F.lit(1), F.ceil((w + floor_w - limit_w) / per)).cast("int")
    wide = wide.withColumn("length", F.col("d") - t + 1).where("length > 0")
    posts = wide.select("g", "node", "c", "core", "own", "other", F.explode(F.slice("order.e", F.lit(1), F.col("length"))).alias("e"))
    one = posts.where("own <= other").select("g", "e", F.col("own").alias("u"), F.col("other").alias("v"), "node", "c", "core")
    two = posts.where("own >= other").select("g", "e", F.col("other").alias("u"), F.col("own").alias("v"), F.col("node").alias("y"), F.col("c").alias("k"), F.col("core").alias("core_y"))
    pairs = one.join(two, ["g", "e", "u", "v"]).where("c != k and not (core and core_y) and (u < v or node < y)")
    pairs = pairs.select(*_pair("node", "y"))
    pairs = materialize((near.unionAll(pairs) if large else near).distinct())
    discard(base, least)
    return sure, pairs


def linked_components(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Components of the nodes whose sets have a Jaccard similarity of percent/100 or more, among nodes that share a bucket.

    members (bucket, node); for the rest see linked_live.
    """
    return linked_live(live_members(members), sets_of, percent)


def linked_live(
    live: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    spread: Callable[[Column], Column] = lambda s: s,
    sketches: DataFrame | None = None,
    alike: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """linked_components of what live_members has written, which is deleted at the end.

    sets_of(frame of node) -> (node, s), where spread(s) is the array of the set's distinct values, each a bigint. Links
    are confirmed on full sets. Result (node, component), nodes without a link left out. sketches (node, sketch) of the
    live nodes, with alike(sketch, sketch), a condition that hardly any linked pair fails, spare the sets of pairs that are far apart.

    First every member is compared with two members of its bucket, then those outside the largest component with two of
    their own, which makes one component of most groups. What is left between components is searched without loss: every
    pair of small buckets, large ones by residuals (residual_pairs), grouped by the component that most of a bucket lies
    in. Pairs inside a component need no comparison, and no list of a bucket's members is ever formed.
    """

    def likely(pairs: DataFrame) -> DataFrame:
        if alike is not None:
            for x in ("a", "b"):
                pairs = pairs.join(sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"of_{x}")), x)
            pairs = pairs.where(alike(F.col("of_a"), F.col("of_b")))
        return materialize(pairs.select("a", "b"))

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node"))

    heads = likely(live.select("node", F.explode(F.array("lo", "mid")).alias("x")).where("node != x").select(*_pair("node", "x")).distinct())
    nodes = materialize(nodes_of(heads).distinct())
    sets = materialize(sets_of(nodes))
    links = _verified(heads, sets, percent, spread)
    discard(nodes, sets, heads)
    found = materialize(connected_components(links))
    discard(links)

    split = _unsettled(live, found)
    large = split.where("k > %d" % FEW)
    some = large.limit(1).count() > 0
    pairs = likely(_few(split).unionAll(_second_heads(split)) if some else _few(split))
    nodes = materialize(nodes_of(pairs).unionAll(large.select("node")).distinct())
    sets = materialize(sets_of(nodes))
    links = _verified(pairs, sets, percent, spread)
    if links.limit(1).count():
        found = _merged(found, links)
    discard(nodes, pairs, links)
    if some:
        discard(split)
        split = _unsettled(live, found)
        groups = materialize(split.where("k > %d" % FEW).select(F.col("main").alias("g"), "node", "c").distinct())
        if groups.limit(1).count():
            sure, pairs = residual_pairs(groups, sets, percent, spread)
            confirmed = _verified(pairs, sets, percent, spread)
            links = sure.unionAll(confirmed)
            if links.limit(1).count():
                found = _merged(found, links)
            discard(sure, pairs, confirmed)
        discard(groups)
    discard(live, split, sets)
    return found
