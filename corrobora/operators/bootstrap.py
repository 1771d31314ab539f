"""Cluster bootstrap of risk and odds ratios, for all arms and transitions at once.

Rows are first summed to one cell vector for each cluster, and clusters with equal vectors are merged with a
multiplicity: drawing them together by a multinomial has the same distribution. Draws are handed down a tree of the
distinct vectors, in blocks of replicates that are seeded by node and block, so the result depends neither on row order
nor on partitions, and an arm of millions of clusters is dealt with in parts.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, small
from .enrichment import TRANSITIONS

REPLICATES, BLOCK = 10_000, 500
#: Distinct cells of a leaf, and children of a node, of the tree by which draws are dealt.
LEAF, FAN = 4096, 64
#: Share of replicates that may leave a ratio undefined; beyond the first there are no bounds, beyond the second a warning.
MOST_UNDEFINED, NOTABLE = 0.25, 0.05
STEP = ["phase_from", "phase_to"]


def cluster_cells(trials: DataFrame, cluster: str, transitions=TRANSITIONS, keys=(), flag: str = "has_genetic_evidence") -> DataFrame:
    """(keys, phase_from, phase_to, cluster, x_yes, n_yes, x_no, n_no); nulls are one cluster. Clusters without an eligible row are left out."""
    from .enrichment import transition_counts

    cells = transition_counts(trials.withColumn("cluster", F.col(cluster).cast("string")), transitions, [*keys, "cluster"], flag)
    return cells.filter("n_yes + n_no > 0")


def arm_sums(cells: DataFrame, keys=()) -> DataFrame:
    """Observed totals of each arm, and whether they can be resampled: two clusters on either side and no zero cell."""
    sums = [F.sum(c).alias(c) for c in ("x_yes", "n_yes", "x_no", "n_no")]
    out = cells.groupBy(*keys, *STEP).agg(*sums, F.count_if(F.col("n_yes") > 0).alias("k_yes"), F.count_if(F.col("n_no") > 0).alias("k_no"))
    usable = (F.col("k_yes") >= 2) & (F.col("k_no") >= 2) & (F.col("x_yes") > 0) & (F.col("x_no") > 0) & (F.col("x_yes") < F.col("n_yes")) & (F.col("x_no") < F.col("n_no"))
    return out.withColumn("usable", usable)


def ratios(a, n1, c, n2):
    """(rr, or) of replicate totals; 0/0 is undefined (null), x/0 infinite."""
    b, d = n1 - a, n2 - c
    divide = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).when(x > 0, F.lit(float("inf")))
    defined = (n1 > 0) & (n2 > 0)
    return F.when(defined, divide(a * n2, c * n1)), F.when(defined, divide(a * d, b * c))


def hashed_replicates(cells: DataFrame, replicates: int, seed: int = 0, keys=()) -> DataFrame:
    """(keys, phase_from, phase_to, r, rr, or_): draw j of replicate r takes the cluster at place md5(seed:r:j) mod n. Any engine with MD5 gives the same."""
    place = Window.partitionBy(*keys, *STEP).orderBy(F.col("cluster").isNotNull(), "cluster")
    slots = cells.withColumn("slot", F.row_number().over(place) - 1)
    arms = slots.groupBy(*keys, *STEP).agg(F.count("*").alias("n"))
    draws = arms.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(-(-replicates // BLOCK), *keys, *STEP, "r")  # a number, or adaptive execution puts these few short rows in one task
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    word = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "j")), 1, 12)
    drawn = draws.withColumn("slot", (F.conv(word, 16, 10).cast("long") % F.col("n")).cast("int")).join(small(materialise(slots)), [*keys, *STEP, "slot"])
    totals = drawn.groupBy(*keys, *STEP, "r").agg(*[F.sum(c).cast("double").alias(c) for c in ("x_yes", "n_yes", "x_no", "n_no")])
    rr, odds = ratios(*(F.col(c) for c in ("x_yes", "n_yes", "x_no", "n_no")))
    return totals.select(*keys, *STEP, "r", rr.alias("rr"), odds.alias("or_"))


def generator(seed: int, block: int, *node: int) -> np.random.Generator:
    """Random numbers of a block of replicates at a node of the tree; the root, which has no number, draws like a leaf."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(block, *node)))


def split_draws(state: DataFrame, weights: DataFrame, level: int, shared: list[str], seed: int) -> DataFrame:
    """(shared, node, block, counts) one level further down: a node's draws of each replicate are dealt to its children by a multinomial of their weights.

    state: (shared, node, block, counts). weights: (shared, node, children), an array of (child, weight) in order.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name in shared)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                w = np.array([c["weight"] for c in row.children], dtype=np.int64)
                dealt = generator(seed, row.block, level, row.node).multinomial(np.asarray(row.counts), w / w.sum()).T
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(w) for k in shared}, "node": [c["child"] for c in row.children], "block": row.block, "counts": list(dealt)})

    return state.join(weights, [*shared, "node"]).mapInPandas(draw, f"{schema}, node long, block int, counts array<long>")


def leaf_sums(state: DataFrame, leaves: DataFrame, shared: list[str], seed: int) -> DataFrame:
    """(shared, r, x_yes, n_yes, x_no, n_no): what the cells of each leaf add to each replicate. leaves: (shared, node, depth, cells), cells in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema if f.name in shared)
    vector = ["x_yes", "n_yes", "x_no", "n_no"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                cells = np.array([[c[k] for k in (*vector, "times")] for c in row.cells], dtype=np.int64)
                rng = generator(seed, row.block, *((row.depth, row.node) if row.depth else ()))
                sums = (rng.multinomial(np.asarray(row.counts), cells[:, 4] / cells[:, 4].sum()) @ cells[:, :4]).T
                yield pd.DataFrame({**{k: [getattr(row, k)] * len(row.counts) for k in shared}, "r": row.block * BLOCK + np.arange(len(row.counts)), **dict(zip(vector, sums))})

    rows = state.join(leaves, [*shared, "node"])
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, *shared, "node", "block").mapInPandas(draw, f"{schema}, r long, {', '.join(f'{c} long' for c in vector)}")


def replicates(cells: DataFrame, n: int = REPLICATES, seed: int = 0, keys=()) -> DataFrame:
    """(keys, phase_from, phase_to, r, rr, or_) by multinomial draws.

    An arm's distinct cells are the leaves' of a tree by hash, FAN children a node, with LEAF cells a leaf or so. A
    replicate's draws are handed down from node to node: a multinomial over a node's children given its count is that
    over all cells, so no row and no task holds an arm of more than LEAF cells. Seeds are those of nodes and blocks.
    """
    vector, shared = ["x_yes", "n_yes", "x_no", "n_no"], [*keys, *STEP]
    merged = cells.groupBy(*shared, *vector).agg(F.count("*").alias("times"))
    depth = F.when(F.count("*") > LEAF, F.ceil(F.log(F.count("*") / LEAF) / F.log(F.lit(float(FAN))))).otherwise(0).cast("int")
    arms = materialise(merged.groupBy(*shared).agg(depth.alias("depth"), F.sum("times").alias("total")))
    deepest = arms.agg(F.max("depth")).first()[0] or 0
    node = lambda level: F.pmod(F.xxhash64(*vector), F.pow(F.lit(FAN), level).cast("long"))
    placed = merged.join(small(arms), shared)
    if deepest:
        placed = materialise(placed)
    size = F.least(F.lit(BLOCK), F.lit(n) - F.col("block") * BLOCK)
    blocks = arms.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // BLOCK) - 1))))
    state = blocks.select(*shared, F.lit(0).cast("long").alias("node"), F.col("block").cast("int"), F.array_repeat("total", size).alias("counts"))
    sums = []
    for level in range(deepest + 1):
        leaves = placed.filter(F.col("depth") == level).groupBy(*shared, node(F.lit(level)).alias("node"), "depth").agg(F.sort_array(F.collect_list(F.struct(*vector, "times"))).alias("cells"))
        sums.append(leaf_sums(state, leaves, shared, seed))
        if level < deepest:
            children = placed.filter(F.col("depth") > level).groupBy(*shared, node(F.lit(level)).alias("node"), node(F.lit(level + 1)).alias("child")).agg(F.sum("times").alias("weight"))
            weights = children.groupBy(*shared, "node").agg(F.sort_array(F.collect_list(F.struct("child", "weight"))).alias("children"))
            state = materialise(split_draws(state, weights, level, shared, seed))
    added = sums[0]
    for more in sums[1:]:
        added = added.unionByName(more)
    if deepest:
        added = added.groupBy(*shared, "r").agg(*[F.sum(c).alias(c) for c in vector])
    rr, odds = ratios(*(F.col(c).cast("double") for c in vector))
    return added.select(*shared, "r", rr.alias("rr"), odds.alias("or_"))


def intervals(drawn: DataFrame, sums: DataFrame, alpha: float = 0.05, keys=()) -> DataFrame:
    """(keys, phase_from, phase_to, rr_boot_lower, rr_boot_upper, or_boot_lower, or_boot_upper): order statistics, NaN where an arm isn't usable or too many replicates leave one of the ratios undefined: the ratio that lost more decides for both."""
    enough = F.least(F.count("rr"), F.count("or_")) >= (1 - MOST_UNDEFINED) * F.count("*")

    def bounds(c: str):
        values = F.array_sort(F.collect_list(c))  # defined values alone
        low = F.floor((F.count(c) - 1) * (alpha / 2)).cast("int") + 1
        high = F.ceil((F.count(c) - 1) * (1 - alpha / 2)).cast("int") + 1
        name = "or" if c == "or_" else c
        return [F.when(enough & (F.count(c) > 0), F.try_element_at(values, at)).alias(f"{name}_boot_{side}") for at, side in ((low, "lower"), (high, "upper"))]

    names = ["rr_boot_lower", "rr_boot_upper", "or_boot_lower", "or_boot_upper"]
    out = sums.join(drawn.groupBy(*keys, *STEP).agg(*bounds("rr"), *bounds("or_")), [*keys, *STEP], "left")
    return out.select(*keys, *STEP, *[F.when(F.col("usable"), F.coalesce(n, F.lit(float("nan")))).otherwise(F.lit(float("nan"))).alias(n) for n in names])


def losses(drawn: DataFrame, keys=()) -> DataFrame:
    """(keys, phase_from, phase_to, lost): the share of replicates that leave a ratio undefined, of the ratio that lost more."""
    return drawn.groupBy(*keys, *STEP).agg((1 - F.least(F.count("rr"), F.count("or_")) / F.count("*")).alias("lost"))


def bootstrap(trials: DataFrame, cluster: str = "gene", n: int = REPLICATES, seed: int = 0, alpha: float = 0.05, transitions=TRANSITIONS, keys=(), flag: str = "has_genetic_evidence", hashed: bool = False, warn: bool = False) -> DataFrame:
    """Intervals by resampling clusters, for each arm and transition. hashed: draws by MD5, which other engines repeat. warn: the replicates are drawn at once, and arms that lost more than NOTABLE of them are warned of."""
    cells = materialise(cluster_cells(trials, cluster, transitions, keys, flag))
    drawn = (hashed_replicates if hashed else replicates)(cells, n, seed, keys)
    sums = arm_sums(cells, keys)
    if warn:
        drawn = materialise(drawn)
        for r in losses(drawn, keys).join(sums.filter("usable").select(*keys, *STEP), [*keys, *STEP]).filter(F.col("lost") > NOTABLE).orderBy(*keys, *STEP).collect():
            what = "no bounds" if r["lost"] > MOST_UNDEFINED else "bounds of the others alone"
            warnings.warn(f"{100 * r['lost']:.1f} % of the replicates of {[r[k] for k in (*keys, *STEP)]} leave a ratio undefined: {what}", stacklevel=2)
    return intervals(drawn, sums, alpha, keys)
