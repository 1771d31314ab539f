"""Interval labels of a directed acyclic graph, so that what lies below a node is a range lookup.

Every node keeps one of its parents; that makes a forest, whose nodes are numbered in the order of a walk, so that the
nodes below one have the numbers of an interval. The walk is a linked list of steps down and up, and pointers are
doubled along it: a chain of n nodes takes 2 n rows in each of log n rounds, never the n^2 / 2 pairs of a closure. The
edges that the forest leaves out add intervals: what is below their child counts for all nodes above their parent,
unless it is in their interval anyway. For the counts below all nodes, the other way round, a node keeps the lowest
points whose paths to the root hold its ancestors: few where it has many ancestors. Points are found in intervals by equality of dyadic blocks: an interval is cut
into blocks of aligned powers of two, at most two of each size, and a point lies in one block of each size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, materialise_with, small
from .graph import ancestors, roots


#: Parts of the children of one parent. The root above all roots.
DEALT, ROOT = 64, "\x00"
#: Edges left for a closure when the layers below are taken off. Numbers of one block of a running sum: 2 to this power.
TOP_EDGES, SUM_BITS = 5_000, 16


@dataclass
class Labels:
    """nodes: (id, low, high), low being the node's own number. tree: (child, parent), the forest under ROOT. left: (child, point, point_high, child_low, child_high), the edges that the forest left out; point is the parent's number. n: the number of nodes. levels: sizes of blocks."""

    nodes: DataFrame
    tree: DataFrame
    left: DataFrame
    n: int
    levels: int

    @cached_property
    def extra(self) -> DataFrame:
        """(id, low, high): further intervals of a node. Those of all nodes are many more than the edges, so they are computed where they are asked for."""
        return further(self.nodes, self.left, self.levels)


def siblings(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, parent, sibling), (id, child)): of each child the next one of its parent, of each parent the first. Children are dealt to DEALT parts that are chained, so one parent of many isn't one task's."""
    dealt = tree.select(F.col("child").alias("id"), "parent", F.pmod(F.xxhash64("child"), F.lit(DEALT)).alias("part"))
    heads = materialise(dealt.groupBy("parent", "part").agg(F.min("id").alias("head")))
    onward = heads.select("parent", "part", F.lead("head").over(Window.partitionBy("parent").orderBy("part")).alias("head"))
    next_ = dealt.withColumn("next", F.lead("id").over(Window.partitionBy("parent", "part").orderBy("id"))).join(onward, ["parent", "part"])
    first = heads.groupBy("parent").agg(F.min_by("head", "part").alias("child"))
    return next_.select("id", "parent", F.coalesce("next", "head").alias("sibling")), first.select(F.col("parent").alias("id"), "child")


def walk(tree: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, from_down, size): of each of the n nodes ids (id) of a tree (child, parent), how many are entered from it on, and how many are at or below it."""
    own, first = siblings(tree)
    step = lambda up, id_: F.struct(F.lit(up).alias("up"), F.col(id_).alias("id"))
    # A step enters a node or leaves it; onward is the step that follows, downs the nodes entered from this step to before that.
    down = ids.join(first, "id", "left").select(step(False, "id").alias("at"), F.when(F.col("child").isNotNull(), step(False, "child")).otherwise(step(True, "id")).alias("onward"), F.lit(1).cast("long").alias("downs"))
    up = ids.join(own, "id", "left").select(step(True, "id").alias("at"), F.when(F.col("sibling").isNotNull(), step(False, "sibling")).when(F.col("parent").isNotNull(), step(True, "parent")).alias("onward"), F.lit(0).cast("long").alias("downs"))
    state = materialise(down.unionByName(up))
    for _ in range(n.bit_length() + 3):
        if not state.filter("onward IS NOT NULL").limit(1).count():
            break
        further = state.select(F.col("at").alias("onward"), F.col("onward").alias("next"), F.col("downs").alias("more"))
        moved = state.filter("onward IS NOT NULL").join(further, "onward").select("at", F.col("next").alias("onward"), (F.col("downs") + F.col("more")).alias("downs"))
        state = materialise(state.filter("onward IS NULL").unionByName(moved))
    else:
        raise ValueError("the edges have a cycle")
    side = lambda up: F.max(F.when(F.col("at.up") == up, F.col("downs")))
    ends = state.groupBy(F.col("at.id").alias("id")).agg(side(False).alias("from_down"), side(True).alias("from_up"))
    return ends.select("id", "from_down", (F.col("from_down") - F.col("from_up")).alias("size"))


def forest(edges: DataFrame) -> DataFrame:
    """(child, parent): of each node's parents the smallest."""
    return edges.groupBy("child").agg(F.min("parent").alias("parent"))


def label(edges: DataFrame) -> Labels:
    """Labels of the nodes of edges (child, parent). Nulls and repeated edges count for nothing."""
    edges = materialise(edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).dropna().filter("child <> parent").distinct())
    ids = materialise(edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct())
    n = ids.count()
    tree = forest(edges)
    # One root above all roots joins their walks.
    roots = ids.join(tree, F.col("id") == F.col("child"), "left_anti")
    whole = materialise(tree.unionByName(roots.select(F.col("id").alias("child"), F.lit(ROOT).alias("parent"))))
    total = n + 1
    walked = walk(whole, ids.union(ids.sparkSession.createDataFrame([(ROOT,)], "id string")), total)
    nodes = materialise(walked.select("id", (F.lit(total) - F.col("from_down")).alias("low"), (F.lit(total) - F.col("from_down") + F.col("size")).alias("high")).filter(F.col("id") != ROOT))
    levels = max(1, total.bit_length())
    left = edges.join(tree, ["child", "parent"], "left_anti")
    at = lambda s: nodes.select(F.col("id").alias(s), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"))
    left = left.join(at("child"), "child").join(at("parent"), "parent")
    outside = (F.col("child_low") < F.col("parent_low")) | (F.col("child_low") >= F.col("parent_high"))
    left = materialise(left.filter(outside).select("child", F.col("parent_low").alias("point"), F.col("parent_high").alias("point_high"), "child_low", "child_high"))
    return Labels(nodes, whole, left, n, levels)


def blocks(intervals: DataFrame, levels: int) -> DataFrame:
    """intervals (low, high, ...) once for each dyadic block (level, block) that they are made of."""
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    up = lambda v, k: F.floor((v + size(k) - 1) / size(k)).cast("long")

    def of(level):
        # Whole blocks of this size inside, less those that a block of twice the size holds.
        low, high = up(F.col("low"), level), F.floor(F.col("high") / size(level)).cast("long")
        low2, high2 = 2 * up(F.col("low"), level + 1), 2 * F.floor(F.col("high") / size(level + 1)).cast("long")
        both = F.array(F.when((low < high) & ((low < low2) | (low2 >= high2)), low), F.when((low < high) & ((high > high2) | (low2 >= high2)), high - 1))
        return F.transform(F.array_distinct(F.array_compact(both)), lambda b: F.struct(level.alias("level"), b.alias("block")))

    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))
    return intervals.select("*", F.explode(each).alias("_b")).select("*", "_b.*").drop("_b")


def points_within(points: DataFrame, intervals: DataFrame, levels: int) -> DataFrame:
    """Rows of points (point, ...) with those of intervals (low, high, ...) in which they lie."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    placed = points.select("*", level).withColumn("block", F.expr("shiftright(point, level)"))
    return placed.join(blocks(intervals, levels), ["level", "block"]).drop("level", "block")


def further(nodes: DataFrame, left: DataFrame, levels: int) -> DataFrame:
    """(id, low, high): intervals of nodes (id, low, high) beyond their own, by the edges that the forest left out: left (child, point, child_low, child_high); point is the parent's number."""
    own = materialise(left.select(F.col("child").alias("id"), F.col("child_low").alias("low"), F.col("child_high").alias("high")).distinct())
    rounds = [own]
    seen, new = own, own
    jumps = left.select("point", "child_low", "child_high").distinct()
    while new.limit(1).count():
        met = points_within(jumps, new, levels).filter("child_low < low OR child_low >= high")
        found = met.select("id", F.col("child_low").alias("low"), F.col("child_high").alias("high")).distinct()
        new = materialise(found.join(seen, ["id", "low", "high"], "left_anti"))
        rounds.append(new)
        seen = rounds[0]
        for more in rounds[1:]:
            seen = seen.unionByName(more)
    reach = seen.select(F.col("id").alias("child"), F.col("low").alias("child_low"), F.col("high").alias("child_high"))
    above = points_within(left.select("point", "child"), nodes, levels).select("id", "low", "high", "child").distinct()
    own_out = above.join(reach, "child").filter("child_low < low OR child_low >= high").select("id", F.col("child_low").alias("low"), F.col("child_high").alias("high"))
    return materialise(own_out.distinct())


def descendants(labels: Labels, root: str) -> DataFrame:
    """(id) at or below a root; the root alone where it has no edge. Only the root's intervals are followed: an edge that the forest left out adds its child's interval once, when its parent is reached."""
    spark = labels.nodes.sparkSession
    new = materialise(labels.nodes.filter(F.col("id") == root).select("low", "high"))
    seen, jumps = new, labels.left.select("point", "child_low", "child_high").distinct()
    while new.limit(1).count():
        met = points_within(jumps, new, labels.levels).filter("child_low < low OR child_low >= high")
        new = materialise(met.select(F.col("child_low").alias("low"), F.col("child_high").alias("high")).distinct().join(seen, "low", "left_anti"))
        seen = seen.unionByName(new)
    points = labels.nodes.select("id", F.col("low").alias("point"))
    return points_within(points, seen, labels.levels).select("id").union(spark.createDataFrame([(root,)], "id string")).distinct()


def lowest(df: DataFrame) -> DataFrame:
    """df (..., points), an array of (low, high), sorted and without points above another one."""
    rows = df.withColumn("points", F.sort_array(F.array_distinct("points")))
    return rows.withColumn("points", F.filter("points", lambda x, i: F.coalesce(F.get("points", i + 1)["low"] >= x["high"], F.lit(True))))


def merged(rows: DataFrame) -> DataFrame:
    """(point, points) of each point: the lowest of all its rows' points."""
    return lowest(rows.groupBy("point").agg(F.flatten(F.collect_list("points")).alias("points")))


def layers(edges: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Edges (child, parent, ...) by child: layer by layer those of nodes that are no parents any more, and what is left: at most TOP_EDGES, what hangs above a cycle, or what is above so many layers. A null parent is none."""
    out: list[DataFrame] = []
    rest, seen = materialise_with(edges, n=F.count("*"))
    while seen["n"] > TOP_EDGES and len(out) < most:
        parents = rest.select(F.col("parent").alias("child")).dropna().distinct().withColumn("inner", F.lit(True))
        flagged, now = materialise_with(rest.select(*edges.columns).join(parents, "child", "left").withColumn("inner", F.col("inner").isNotNull()), n=F.count_if("inner"))
        if now["n"] == seen["n"]:
            break
        out.append(flagged.filter("NOT inner"))
        rest, seen = flagged.filter("inner"), now
    return out, rest


def covers(labels: Labels, ups: DataFrame) -> DataFrame:
    """(point, points) of each node of ups (id, point, high, up): the lowest points (low, high) whose paths to the root in the forest hold all its ancestors, and no more.

    Only nodes that have edges which the forest left out get more than their own point, and what is below them. These
    nodes' points are handed down layer by layer, so each is sent along an edge once; the few nodes at the top, and
    cycles, are met by their closure.
    """
    span = lambda low, high: F.struct(F.col(low).alias("low"), F.col(high).alias("high"))
    keys = materialise(labels.left.select(F.col("child_low").alias("point")).distinct())
    # Of the other nodes, the nearest such node above, or 0.
    held = roots(ups.join(keys, "point", "left_anti").select(F.col("point").alias("node"), "up"))
    steps = ups.join(keys, "point", "left_semi").select(F.col("point").alias("child"), F.col("up").alias("parent"), span("point", "high").alias("span"))
    steps = steps.unionByName(labels.left.select(F.col("child_low").alias("child"), F.col("point").alias("parent"), span("point", "point_high").alias("span")))
    steps = steps.join(small(held.select(F.col("node").alias("parent"), F.col("up").alias("key"))), "parent", "left").withColumn("parent", F.coalesce("key", "parent"))
    edges = steps.select("child", F.when((F.col("parent") > 0) & (F.col("parent") != F.col("child")), F.col("parent")).alias("parent"), "span")
    below, top = layers(edges, 4 * labels.n.bit_length())
    names, above = ancestors(top.select("child", "parent"))
    at = lambda c, n: names.select(F.col("number").alias(n), F.col("id").alias(c))
    reach = above.select("number", F.explode("above").alias("up")).join(at("point", "number"), "number").join(at("child", "up"), "up").select("point", "child")
    reach = reach.unionByName(top.select(F.col("child").alias("point"), "child")).distinct()
    done = materialise(merged(reach.join(top, "child").select("point", F.array("span").alias("points"))))
    for layer in reversed(below):
        told = layer.join(done.select(F.col("point").alias("parent"), "points"), "parent", "left")
        told = told.select(F.col("child").alias("point"), F.when(F.col("points").isNull(), F.array("span")).otherwise(F.array_append("points", F.col("span"))).alias("points"))
        done = done.unionByName(materialise(merged(told)))
    plain = ups.join(held.select(F.col("node").alias("point"), F.col("up").alias("key")), "point").join(done.select(F.col("point").alias("key"), "points"), "key", "left")
    own = span("point", "high")
    plain = plain.select("point", F.when(F.col("points").isNull(), F.array(own)).otherwise(F.array_append("points", own)).alias("points"))
    return done.unionByName(lowest(plain))


def meeting(pairs: DataFrame, ups: DataFrame) -> DataFrame:
    """pairs (a, b, ...), a before b and not above it, with `up`, the number of the lowest node of the forest above both; 0 for none. b climbs by powers of two as long as it stays behind a."""
    jumps = [ups.filter("up > 0").select("point", "up")]
    while True:
        last = jumps[-1]
        twice, seen = materialise_with(last.join(last.select(F.col("point").alias("up"), F.col("up").alias("top")), "up").select("point", F.col("top").alias("up")), n=F.count("*"))
        if not seen["n"]:
            break
        jumps.append(twice)
    at = pairs.withColumn("point", F.col("b"))
    for jump in reversed(jumps):
        at = at.join(small(jump), "point", "left").withColumn("point", F.when(F.col("up") > F.col("a"), F.col("up")).otherwise(F.col("point"))).drop("up")
    return at.join(ups.select("point", "up"), "point").drop("point")


def counts_below(labels: Labels) -> DataFrame:
    """(id, n) of each node: the nodes at or below it.

    A node's ancestors are the paths to the root from its points: 1 at each point and -1 where neighbouring ones meet,
    summed over an interval, is 1 for each node above one of them, and 0 for others. So a count is a sum over the node's
    interval, the difference of two running sums. Neighbours that many nodes share are counted first.
    """
    if labels.left.isEmpty():
        return labels.nodes.select("id", (F.col("high") - F.col("low")).cast("long").alias("n"))
    at = lambda c, n: labels.nodes.select(F.col("id").alias(c), F.col("low").alias(n))
    ups = labels.nodes.join(labels.tree, F.col("id") == F.col("child")).join(at("parent", "up"), "parent", "left")
    ups = materialise(ups.select("id", F.col("low").alias("point"), "high", F.coalesce("up", F.lit(0)).cast("long").alias("up")))
    neighbours = F.transform("points", lambda x, i: F.struct(F.get("points", i - 1)["low"].alias("a"), x["low"].alias("b")))
    pairs = materialise(covers(labels, ups).select(F.explode(neighbours).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    met = meeting(pairs.filter("a IS NOT NULL"), ups).select(F.col("up").alias("point"), (-F.col("n")).alias("n"))
    weights = pairs.select(F.col("b").alias("point"), "n").unionByName(met).groupBy("point").agg(F.sum("n").alias("n"))
    rows = ups.select("id", "point", "high").join(weights, "point", "left").select("id", "point", "high", F.coalesce("n", F.lit(0)).alias("n"), F.shiftright("point", SUM_BITS).alias("block"))
    rows = materialise(rows)
    before = rows.groupBy("block").agg(F.sum("n").alias("all")).select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("before"))
    upto = (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("point"))).alias("upto")
    sums = materialise(rows.join(F.broadcast(before), "block").select("id", "point", "high", "n", upto))
    ends = sums.select((F.col("point") + 1).alias("high"), F.col("upto").alias("end"))
    return sums.join(ends, "high").select("id", (F.col("end") - F.col("upto") + F.col("n")).alias("n"))


def information_content(labels: Labels) -> DataFrame:
    """(id, ic): -ln of the share of all nodes that are at or below one."""
    return counts_below(labels).select("id", (0.0 - F.ln(F.col("n") / labels.n)).alias("ic"))
