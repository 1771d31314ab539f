"""Fixpoints over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, materialise_with, new_path, small


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b); label: the smallest node of the component. Edges with a null end are none."""
    given = materialise(edges.select("a", "b").dropna().distinct())
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(small(smaller(given)), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def smaller(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b) that aren't the smallest of their component, which is the label. Edges with a null end are none.

    Each round hooks every node to its smallest neighbour, if that is smaller, follows these pointers to their roots by
    doubling, and shrinks the edges to pairs of different roots: finished components are gone from the next round, and
    of the others at least half of the nodes. Pointers only lead to smaller nodes, so a component's last root is its
    smallest node. A node is hooked in one round only, so the rounds' pointers, each led on by those of the later rounds,
    are the result.
    """
    edges, seen = materialise_with(between(edges), n=F.count("*"))
    levels: list[DataFrame] = []
    while seen["n"]:
        # The larger end comes first, so a node with a smaller neighbour stands there, and no other.
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = roots(hooks)
        levels.append(up)
        end = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: E731, B023
        moved = edges.join(small(end("a")), "a").join(small(end("b")), "b", "left")
        edges, seen = materialise_with(between(moved.select(F.col("a_up").alias("a"), F.coalesce("b_up", "b").alias("b"))), n=F.count("*"))
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = levels.pop().select("node", F.col("up").alias("label"))
    while levels:
        further = out.select(F.col("node").alias("up"), F.col("label").alias("top"))
        out = materialise(levels.pop().join(small(further), "up", "left").select("node", F.coalesce("top", "up").alias("label")).unionByName(out))
    return out


def between(edges: DataFrame) -> DataFrame:
    """The edges between different nodes, each once, the larger end first."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with up a root, of pointers (node, up) that lead to smaller nodes; roots have no row."""
    state = materialise(hooks)
    while True:
        further = state.select(F.col("node").alias("up"), F.col("up").alias("top"))
        after, seen = materialise_with(state.join(small(further), "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), moved=F.count_if("moved"))
        state = after.select("node", "up")
        if not seen["moved"]:
            return state


def ancestors(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, number), (number, above)): all nodes of edges (child, parent) with a number each, and by number those of its ancestors, itself included. Edges with a null end are none.

    After k rounds `above` has what is fewer than 2^k steps away, by the shortest path, and `far` what is 2^k steps
    away. What is fewer than twice as far is above one of these, so only nodes at 2^k steps are asked for their
    ancestors, not all that are known; a path of n takes log n rounds. A node's ancestors are one row's array.
    """
    given = materialise(edges.select("child", "parent").dropna().distinct())
    names = materialise(given.select(F.explode(F.array("child", "parent")).alias("id")).distinct().withColumn("number", F.monotonically_increasing_id()))
    at = lambda c, n: small(names.select(F.col("id").alias(c), F.col("number").alias(n)))
    ups = given.filter("child <> parent").join(at("child", "number"), "child").join(at("parent", "up"), "parent").groupBy("number").agg(F.collect_list("up").alias("far"))
    none = F.array().cast("array<bigint>")
    state = names.select("number").join(ups, "number", "left").select("number", F.array("number").alias("above"), F.coalesce("far", none).alias("far"))
    state, seen = materialise_with(state, more=F.count_if(F.size("far") > 0))
    while seen["more"]:
        asked = state.select("number", F.explode(F.concat(F.array("number"), "far")).alias("mid"))
        told = asked.join(state.select(F.col("number").alias("mid"), "above", "far"), "mid")
        further = F.when(F.col("mid") != F.col("number"), F.col("far"))
        met = told.groupBy("number").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(n) for c, n in ((F.col("above"), "above"), (further, "far"))])
        state, seen = materialise_with(met.select("number", "above", F.array_except("far", "above").alias("far")), more=F.count_if(F.size("far") > 0))
    return names, state.select("number", "above")


def descendants(edges: DataFrame, root: str) -> DataFrame:
    """(id) at or below a root of (child, parent): a frontier that goes down and drops what was seen. Each frontier is written once, as a partition of one table."""
    spark = edges.sparkSession
    path, depth = new_path(spark), 0
    down = materialise(edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).dropna())
    frontier = spark.createDataFrame([(root,)], "id string")
    while True:
        frontier.write.parquet(f"{path}/depth={depth}")
        table = spark.read.schema("id string, depth int").parquet(path)
        last, seen = table.filter(F.col("depth") == depth).select("id"), table.select("id")
        if last.isEmpty():
            return seen
        below = down.join(last, down["parent"] == last["id"], "left_semi").select(F.col("child").alias("id")).distinct()
        frontier, depth = below.join(seen, "id", "left_anti"), depth + 1
