"""SimHash near-dedup by vantage-point trees.

A fingerprint has a bit set where over half of the hashes of a text's shingles have it. Fingerprints at no more than
`radius` differing bits are linked, and components of links are groups of near duplicates.

Search, exact for any radius: the 64 bits are cut into `blocks` blocks. Of two fingerprints within the radius, some
block differs in at most radius // blocks bits. For each block there is a vantage-point tree: an inner node has a
vantage point and a distance, and sends a fingerprint left if its block is at most that Hamming distance from the
point, else right; leaves are shards. Every fingerprint is at home in one shard. As a query with a ball of the block's
radius r, it goes down a branch only where the triangle bound lets the ball reach it (d - r <= split, d + r > split), so
it visits the shards that its ball overlaps at a boundary, and there all home fingerprints are compared in full.
A pair needs to meet once, so queries skip shards before their own. Trees are built from a sample of about LEAF_SAMPLE
fingerprints a leaf, some LEAF_SAMPLE << MAX_DEPTH at most; any tree gives exact pairs, the sample only balances it.

Shards with many homes or queries (clusters of near copies) are cut into parts by their counts, so no task grows with
a cluster. A part returns a spanning forest of its links, no more rows than it has fingerprints; components are then
found by min-label hooking and pointer jumping over tables. Rows look their component up by fingerprint, and only those
fingerprints that have several rows or links are in that table, so no row meets a large component's label.

Defined cases: null text counts as empty; very long texts are read whole, with some 100 bytes a word in memory; texts without words have fingerprint zero and are linked like others; texts
with fewer words than a shingle have one shingle, the whole sequence; a null doc_id is in its component, but isn't its
name unless no other is (then null). Equal texts have equal fingerprints. An empty table gives no rows. Only doc_id and
text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 3
#: Fingerprints that a shard should hold; most homes and queries that one part compares.
SHARD, PART_HOMES, PART_QUERIES = 2048, 32_768, 65_536
#: Depth of the trees at most; fingerprints that build them, for each leaf, and at least.
MAX_DEPTH, LEAF_SAMPLE, LEAST_SAMPLE = 18, 16, 8192
#: Comparisons that are held in memory at once.
AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number. bytes.lower() changes A-Z alone; bytes.split() divides at ASCII white space alone."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sha, fp) of each row; sha: the text's SHA-256."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([fingerprint(t, shingle) for t in some], dtype="int64")

    return docs.select("doc_id", F.sha2(common.text_or_empty(), 256).alias("sha"), run(F.col("text").cast("string")).alias("fp"))


class Tree:
    """A vantage-point tree over one block of bits. Nodes are numbered from 1, the children of i being 2i and 2i + 1."""

    def __init__(self, sample: np.ndarray, shift: int, bits: int, depth: int, seed: int):
        self.shift, self.mask, self.depth = np.uint64(shift), np.uint64((1 << bits) - 1), depth
        rng = np.random.default_rng(seed)
        self.points, self.splits = np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int64)
        members = {1: self.block(sample)}
        for at in range(1, 1 << depth):
            here = members.pop(at)
            tries = rng.choice(here, min(4, len(here)), replace=False) if len(here) else rng.integers(0, 1 << bits, 1, dtype=np.uint64)
            best = None
            for point in tries:
                d = np.bitwise_count(here ^ point).astype(np.int64) if len(here) else np.array([bits // 2])
                split = int(np.median(d))
                for s in (split - 1, split):
                    odds = abs(2 * int((d <= s).sum()) - len(d))
                    if best is None or odds < best[0]:
                        best = odds, point, s
            _, self.points[at], self.splits[at] = best
            if 2 * at < 1 << depth:
                far = np.bitwise_count(here ^ self.points[at]) > self.splits[at]
                members[2 * at], members[2 * at + 1] = here[~far], here[far]

    def block(self, fps: np.ndarray) -> np.ndarray:
        return (fps.astype(np.int64).view(np.uint64) >> self.shift) & self.mask

    def home(self, fps: np.ndarray) -> np.ndarray:
        own, node = self.block(fps), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.bitwise_count(own ^ self.points[node]) > self.splits[node])
        return node - (1 << self.depth)

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(which fingerprint, shard): the shards that balls of the radius may overlap, from each one's home on."""
        own, which, node = self.block(fps), np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            d, split = np.bitwise_count(own[which] ^ self.points[node]).astype(np.int64), self.splits[node]
            near, far = d - radius <= split, d + radius > split
            which, node = np.concatenate((which[near], which[far])), np.concatenate((2 * node[near], 2 * node[far] + 1))
        shard = node - (1 << self.depth)
        after = shard >= self.home(fps)[which]
        return which[after], shard[after]


def plant(fps: DataFrame, count: int, blocks: int) -> list[Tree]:
    """One tree a block, deep enough for shards of about SHARD of `count` fingerprints, from a sample by hash."""
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, count / SHARD))))))
    share = max(LEAST_SAMPLE, LEAF_SAMPLE << depth) / max(1, count)
    sample = np.sort(fps.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(min(1.0, share) * (1 << 40))).toArrow()["fp"].to_numpy())
    edges = [round(64 * b / blocks) for b in range(blocks + 1)]
    return [Tree(sample, low, high - low, depth, b) for b, (low, high) in enumerate(zip(edges, edges[1:]))]


def forest(size: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, given links a-b, on top of earlier labels."""
    label = np.arange(size) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root): links whose components are those of all pairs within the radius. fps: distinct."""
    spark = fps.sparkSession
    trees = spark.sparkContext.broadcast(plant(fps, fps.count(), blocks))  # at most 2^MAX_DEPTH nodes a tree
    reach = radius // blocks

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for b, tree in enumerate(trees.value):
                which, shard = tree.visits(fp, reach)
                yield pd.DataFrame({"fp": fp[which], "block": b, "shard": shard, "home": False})
                yield pd.DataFrame({"fp": fp, "block": b, "shard": tree.home(fp), "home": True})

    routed = common.materialise(fps.select("fp").mapInPandas(route, "fp long, block int, shard int, home boolean"))
    counts = routed.groupBy("block", "shard").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("queries"))
    parts = counts.select("block", "shard", F.ceil(F.col("homes") / PART_HOMES).cast("int").alias("hs"), F.ceil(F.col("queries") / PART_QUERIES).cast("int").alias("qs")).filter("hs > 0 AND qs > 0")
    own = lambda n: F.array(F.pmod(F.xxhash64("fp"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = common.lookup(routed, parts, ["block", "shard"])
    dealt = dealt.withColumn("h", F.explode(F.when(F.col("home"), own("hs")).otherwise(every("hs")))).withColumn("q", F.explode(F.when(F.col("home"), every("qs")).otherwise(own("qs"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home = pdf["fp"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        nodes = np.unique(fp)
        homes, queries = np.unique(fp[home]), np.unique(fp[~home])
        at_home, at_query = np.searchsorted(nodes, homes), np.searchsorted(nodes, queries)
        label = np.arange(len(nodes))
        step = max(1, AT_ONCE // max(1, len(homes)))
        for at in range(0, len(queries), step):
            near = np.bitwise_count((queries[at : at + step, None] ^ homes[None, :]).view(np.uint64)) <= radius
            i, j = np.nonzero(near)
            label = forest(len(nodes), at_query[at + i], at_home[j], label)
        linked = label != np.arange(len(nodes))
        return pd.DataFrame({"fp": nodes[linked], "root": nodes[label[linked]]})

    return dealt.select("block", "shard", "h", "q", "fp", "home").groupBy("block", "shard", "h", "q").applyInPandas(compare, "fp long, root long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, label) of the fingerprints that have links; label: the smallest of the component.

    Each round takes the smallest label among a node and its neighbours, hands it to the root that the node had, and
    jumps to the label of the label. Labels only fall; it ends when none does.
    """
    edges = common.materialise(edges)
    both = edges.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(edges.select("root", "fp"))
    state = common.materialise(both.select(F.col("a").alias("fp"), F.col("a").alias("label")).distinct())
    while True:
        seen = both.join(state.select(F.col("fp").alias("b"), "label"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("label").alias("near"))
        step = common.materialise(state.join(seen, "fp", "left").select("fp", "label", F.least("label", "near").alias("next")))
        hooked = step.groupBy(F.col("label").alias("root")).agg(F.min("next").alias("hook"))
        lower = common.materialise(step.join(hooked.withColumnRenamed("root", "fp"), "fp", "left").select("fp", "label", F.least("next", "hook").alias("next")))
        jump = lower.select(F.col("fp").alias("of"), F.col("next").alias("top"))
        after = common.materialise(lower.join(jump, F.col("next") == F.col("of")).select("fp", "label", F.least("next", "top").alias("next")))
        changed = after.filter("label <> next").limit(1).count()
        state = after.select("fp", F.col("next").alias("label"))
        if not changed:
            return state


def groups(docs: DataFrame, radius: int, blocks: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sha, fp) of each row, and (fp, winner) of the fingerprints that have several rows or links: the first row of the component, as (unnamed, doc_id, sha). Any other row is its own component."""
    rows = common.materialise(fingerprints(docs, shingle))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha")
    fps = common.materialise(rows.groupBy("fp").agg(F.min(own).alias("first"), F.count("*").alias("n")))
    linked = common.materialise(components(links(fps, radius, blocks)).join(fps, "fp").select("fp", "label", "first"))
    winners = linked.groupBy("label").agg(F.min("first").alias("winner"))
    of_linked = common.lookup(linked.select("fp", "label"), common.materialise(winners), "label").select("fp", "winner")
    of_copies = fps.filter("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("winner"))
    return rows, common.materialise(of_linked.unionByName(of_copies))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    rows, winners = groups(docs, radius, blocks, shingle)
    named = F.when(F.col("winner").isNotNull(), F.col("winner.doc_id")).otherwise(F.col("doc_id"))
    return common.lookup(rows, winners, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named.alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """The documents, one of each component, with all their columns: the one with the smallest doc_id, of several with it the one whose text has the lowest digest, then see common.keep_decided."""
    rows, winners = groups(docs, radius, blocks, shingle)
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sha")
    kept = F.col("winner").isNull() | F.col("winner").eqNullSafe(own)
    return common.keep_decided(docs, common.lookup(rows, winners, "fp", "left").select("doc_id", F.col("sha").alias("text_sha256"), kept.alias("kept")))


def op5_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
