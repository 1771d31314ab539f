"""Helpers that the operators share: reading tables, cutting lineage, bounded Arrow batches, filtering by decisions."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, materialise, shared_dir, table  # noqa: F401

#: A word: a longest run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Most rows and bytes in one Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20
#: Bits of one bitmap of Spark's bitmap functions; of all bitmaps for each key, and of all of them at most (64 MB).
BITMAP, BITS_A_KEY, MAX_BITS = 1 << 15, 64, 1 << 29


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small for tables whose rows can be long texts. Spark reads these settings when a job starts, so they stay set in the session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def text_or_empty(name: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def host_of(url):
    """The host of a URL column: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://" and for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joins df with a table of one row per key. The table is counted first (callers pass what is written out or cheap) and broadcast only up to BROADCAST_ROWS; beyond, Spark's shuffled join splits hot keys."""
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, on, how)


def shuffled(df: DataFrame) -> DataFrame:
    """df, as a side of a join that Spark is not to broadcast: it sizes a table by its compressed files and an explode by the rows that go in."""
    return df.hint("merge")


def slot_of(bits: int):
    return F.pmod(F.xxhash64("id", "sha"), F.lit(bits))


def may_be_in(keyed: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """keyed with `maybe`: false only where (id, sha) isn't among the n keys of marked. The keys' hashes set bits of bitmaps, BITS_A_KEY bits a key up to MAX_BITS in all, which are broadcast; more keys only raise the share of false alarms."""
    bits = min(MAX_BITS, max(BITMAP, 1 << ceil(log2(max(1, BITS_A_KEY * n)))))
    slot = slot_of(bits)
    maps = marked.groupBy(F.floor(slot / BITMAP).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("bitmap"))
    held = keyed.withColumn("slot", slot).join(F.broadcast(maps), F.floor(F.col("slot") / BITMAP).cast("int") == F.col("bucket"), "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("slot") % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(slot % 8 as int))")) != 0
    return held.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("slot", "bucket", "bitmap")


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that `decided` (doc_id, text_sha256, kept; one row for each of docs) keeps, with all their columns.

    Of rows that agree in doc_id and text, which decisions can't tell apart, the one that comes first by its other
    columns stays (a null text before an empty one). Only keys that are dropped or shared by several rows are looked
    up: up to BROADCAST_ROWS such keys in a broadcast table; more of them are told by a broadcast bitmap, so that only
    rows that may have such a key are shuffled, and the rest stay where they are read.
    """
    decided = materialise(decided.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"))
    keys = decided.groupBy("id", "sha").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    marked = materialise(keys.filter("NOT kept OR n > 1").select("id", "sha", F.col("kept").alias("tied")))
    n = marked.count()
    if not n:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.sha2(text_or_empty(), 256).alias("sha"))
    others = [F.to_json(F.struct(f"row.`{c}`")) if kind.startswith(("map", "array", "struct", "variant")) else F.col(f"row.`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text")]
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("digest"))
    marks = marked.select(F.col("id").alias("of"), F.col("sha").alias("digest"), "tied")
    if n <= BROADCAST_ROWS:
        held = keyed.join(F.broadcast(marks), same, "left")
        passed = held.filter("tied IS NULL").select("row.*")
    else:
        checked = may_be_in(keyed, marked, n)
        held = checked.filter("maybe").join(marks, same, "left")
        passed = checked.filter("NOT maybe").select("row.*").unionByName(held.filter("tied IS NULL").select("row.*"))
    if not marked.filter("tied").limit(1).count():
        return passed
    first = held.filter("tied").groupBy("id", "sha").agg(F.min_by("row", F.struct(F.col("row.text").isNotNull(), *others)).alias("row"))
    return passed.unionByName(first.select("row.*"))
