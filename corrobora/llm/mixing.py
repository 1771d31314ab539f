"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of its doc_id. A source whose target is t times its size takes each of its documents
floor(t) times, and once more those with a hash up to a threshold. Thresholds are nested: a smaller budget takes a
subset of what a larger one takes. A threshold is found by summing sizes by source and hash bucket, finding the bucket
in which the running sum crosses the budget, and refining that bucket alone until it holds one hash. The rows are
filtered by their hashes; nothing is sorted.

Defined cases: null text counts as empty (size 0), and very long texts count whole; null source is a source of its own, the last; null doc_id hashes
like the empty string; rows of one source with equal doc_id have equal hashes and are taken alike; a source of size 0
has target 0; an empty table gives no rows. Only doc_id, source and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hashes have 60 bits: the first 15 hex digits of the MD5 of the doc_id.
HASH_DIGITS = 15
#: Bits of the hash that one round of histograms resolves.
BUCKET_BITS = 12
#: No document is taken more often.
MOST_COPIES = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text):
    """Words of a text column: each becomes one character, then what is between them goes."""
    short = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), common.WORD, "w"), common.SPACE, "")
    return F.length(short).cast("long")


def doc_hash(doc_id):
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of each row, written out: the rounds read these narrow rows, not the texts."""
    return common.materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.0, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, weight, target): share of all words, divided by weight; what a target has above most_copies times its source's size goes to the others by weight, until none is above."""
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks without one task for all sources: range-partition, number within each range, add the counts of the ranges before.
    ranged = common.materialise(sizes.repartitionByRange(8, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    starts, at = [], 0
    for part in sorted(counts):
        starts.append((part, at))
        at += counts[part]
    starts = spark.createDataFrame(starts, "part int, start long")
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    rank = F.col("start") + F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = common.materialise(ranged.join(F.broadcast(starts), "part").select("source", "source_size", weight.cast("long").alias("weight")))

    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight; it only rises, so a source at its limit stays there
    limit = F.col("source_size") * most_copies
    while True:
        full = F.col("weight") * F.lit(level) > limit
        free, fixed = ranked.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, limit))).first()
        rise = (wanted - (fixed or 0)) / free if free else level
        if rise <= level:
            break
        level = rise
    full = F.col("weight") * F.lit(level) > limit
    return ranked.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix_plan(rows: DataFrame, targets: DataFrame, most_copies: int = MOST_COPIES) -> DataFrame:
    """Adds (copies, threshold) to each source's target: all its documents are taken `copies` times, those with h <= threshold once more."""
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_copies))).otherwise(0)
    state = targets.withColumn("copies", copies.cast("long"))
    state = state.withColumn("rest", F.when(F.col("copies") < most_copies, F.col("target") - F.col("copies") * F.col("source_size")).otherwise(0.0))
    state = common.materialise(state.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "low": F.lit(None).cast("long"), "inside": F.lit(None).cast("long")}))
    bits = 4 * HASH_DIGITS
    for shift in range(bits - BUCKET_BITS, -1, -BUCKET_BITS):
        inside = common.lookup(rows.filter("size > 0"), state.select(F.col("source").alias("s"), "prefix", "rest"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BUCKET_BITS) == F.col("prefix")) & (F.col("rest") > 0))
        buckets = inside.groupBy("s", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("b"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = Window.partitionBy("s").orderBy("bucket")
        running = buckets.withColumn("upto", F.sum("b").over(upto)).join(state.select(F.col("source").alias("s2"), F.col("before").alias("start"), F.col("rest")), F.col("s").eqNullSafe(F.col("s2")))
        crossing = running.filter(F.col("start") + F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bucket", (F.col("start") + F.col("upto") - F.col("b")).alias("before"), "low", "high", "b"), "bucket").alias("x"))
        state = common.materialise(
            state.drop("prefix", "before", "low", "inside")
            .join(crossing, F.col("source").eqNullSafe(F.col("s")), "left")
            .select("source", "source_size", "weight", "target", "copies", "rest", F.col("x.bucket").alias("prefix"), F.col("x.before").alias("before"), F.col("x.low").alias("low"), F.col("x.b").alias("inside"), (F.col("x.high") > F.col("x.low")).alias("wide"))
        )
        open_ones = state.filter("wide").count()
        state = state.drop("wide")
        if not open_ones:
            break
    # One hash is left in the crossing bucket: it counts if that comes nearer to the budget.
    nearer = F.col("before") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("before")
    everything = F.lit(1 << bits).cast("long")
    threshold = F.when(F.col("rest") <= 0, F.lit(-1)).when(F.col("low").isNull(), F.when(F.col("source_size") > 0, everything).otherwise(F.lit(-1))).when(nearer, F.col("low")).otherwise(F.col("low") - 1)
    return state.select("source", "source_size", "weight", "target", "copies", threshold.cast("long").alias("threshold"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and n_copies to rows that have source and h."""
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "copies", "threshold")
    out = common.lookup(rows, plan, F.col("source").eqNullSafe(F.col("plan_source")))
    return out.withColumn("n_copies", F.col("copies") + (F.col("h") <= F.col("threshold")).cast("long")).drop("plan_source", "copies", "threshold")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_copies) of each document; taken is n_copies times size."""
    rows = measured(docs)
    plan = mix_plan(rows, source_targets(rows, weights, share))
    return with_copies(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"), "n_copies")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns of docs."""
    rows = measured(docs)
    plan = mix_plan(rows, source_targets(rows, weights, share))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("source").alias("source"), doc_hash(F.col("doc_id")).alias("h"))
    taken = with_copies(keyed, plan).filter("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))).alias("copy")).select("row.*")


def op1_mixing(spark, sf_dir) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS wanted FROM s),
lvl(n, level, rise) AS (
  SELECT 0, CAST(0 AS DOUBLE), (SELECT wanted FROM t) / (SELECT CAST(sum(weight) AS DOUBLE) FROM s)
  UNION ALL
  SELECT n + 1, rise, (SELECT (any_value(t.wanted) - coalesce(sum(CASE WHEN s.weight * l.rise > 3 * s.source_size THEN 3 * s.source_size END), 0)) / CAST(sum(CASE WHEN NOT s.weight * l.rise > 3 * s.source_size THEN s.weight END) AS DOUBLE) FROM s, t)
  FROM lvl l WHERE rise > level),
top AS (SELECT max(level) AS level FROM lvl),
g AS (SELECT source, source_size, weight, CASE WHEN weight * level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM s, top),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS copies FROM g),
r AS (SELECT *, CASE WHEN copies < 3 THEN target - copies * source_size ELSE 0 END AS rest FROM p),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.copies, r.rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS own
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST((copies + e) * size AS BIGINT) AS taken, CAST(copies + e AS BIGINT) AS n_copies
FROM (SELECT *, CASE WHEN rest > 0 AND source_size > 0 AND (upto <= rest OR upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END AS e FROM c)
"""
