"""Exact dedup by a minimal perfect hash over historical distinct digests.

The index of the history has one row per shard of digests (by their first bits). A shard's row holds a minimal perfect
hash function (levels of bits: a digest's slot is the rank of the bit that it alone set) and, slot by slot, the full
digest, the locator of the winner (its doc_id) and the size of the group. A looked-up digest counts as a member only
if its slot holds the same 32 bytes; all others are nonmembers and are grouped among themselves.

Rows are looked up shard by shard, a shard with many rows (a hot digest) in as many salted parts as its count asks for,
so no task holds more than about PART_ROWS of them.

A table without an older history is taken as one and the batch after it, by a hash of doc_id: its one half is indexed,
the other is looked up there. Repeats add to the size of their group, and may win it; nonmembers are grouped among
themselves and get an index of their own, through which their rows find their group.

Defined cases: null text counts as empty; the empty text is a text like any other; very long texts are only hashed, by
Spark. Of equal texts the row with the largest doc_id stays, a null doc_id below all others. Rows equal in text and
doc_id are equally kept (they are one document listed twice); `deduplicated` then leaves one of them, see
common.keep_decided. An empty table, or an empty history, gives no members. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Digests that a shard should have about.
SHARD_DIGESTS = 50_000
#: Rows that are looked up in one group.
PART_ROWS = 100_000
#: Bits per digest at each level of the hash function.
SPARSE = 2.0
MAX_LEVELS = 40

INDEX_SCHEMA = "shard int, levels array<int>, bits binary, ranks binary, digests binary, winners binary, sizes binary"


def digests(docs: DataFrame) -> DataFrame:
    """(id, named, digest, salt): the doc_id (0 if it is null, not named; pandas rounds long numbers next to nulls), SHA-256 of the text's UTF-8 bytes, and a number that tells rows apart. Written out, so that the numbers stay when tasks are run again."""
    doc_id = F.col("doc_id").cast("long")
    return common.materialise(docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("named"), F.unhex(F.sha2(common.text_or_empty(), 256)).alias("digest"), F.monotonically_increasing_id().alias("salt")))


def own_id():
    return F.when(F.col("named"), F.col("id"))


def shard_of(n_shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n_shards)).cast("int").alias("shard")


def as_words(column) -> np.ndarray:
    """Digests as rows of four 64-bit numbers."""
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(-1, 4)


def positions(words: np.ndarray, level: int, width: int) -> np.ndarray:
    """The place of each digest among the bits of a level: its own words, mixed anew for every level."""
    with np.errstate(over="ignore"):
        x = words[:, 1] + words[:, 2] * np.uint64(2 * level + 1) + np.uint64(level)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(width)).astype(np.int64)


def build_function(words: np.ndarray):
    """Levels of bits such that every distinct digest sets one bit alone; the rest go on to the next level."""
    widths, bits, left = [], [], np.arange(len(words))
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        width = max(64, int(SPARSE * len(left)) // 8 * 8 + 8)
        at = positions(words[left], level, width)
        alone = np.bincount(at, minlength=width) == 1
        widths.append(width)
        bits.append(alone)
        left = left[~alone[at]]
    if len(left):
        raise ValueError("digests that are not distinct can't be indexed")
    return widths, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(words: np.ndarray, widths, bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has a bit for it. ranks: bits set before each bit."""
    slots, left, base = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, width in enumerate(widths):
        if not len(left):
            break
        at = base + positions(words[left], level, width)
        hit = bits[at]
        slots[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + width
    return slots


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    words = as_words(pdf["digest"])
    widths, bits = build_function(words)
    ranks = np.cumsum(bits) - bits
    order = np.empty(len(words), np.int64)
    order[find_slots(words, widths, bits, ranks)] = np.arange(len(words))
    block = np.add.reduceat(bits, np.arange(0, len(bits), 64)) if len(bits) else np.zeros(0, int)
    winners = np.zeros(len(words), [("named", "u1"), ("id", "<i8")])
    winners["named"], winners["id"] = pdf["winner_named"], pdf["winner_id"]
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])], "levels": [widths], "bits": [np.packbits(bits).tobytes()], "ranks": [(np.cumsum(block) - block).astype("<i8").tobytes()],
            "digests": [words[order].tobytes()], "winners": [winners[order].tobytes()], "sizes": [pdf["size"].to_numpy("<i8")[order].tobytes()],
        }
    )


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The index of a history of documents, and its number of shards. One row per shard, bounded by SHARD_DIGESTS or so."""
    return index_of(grouped(digests(docs)))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, winner, size) of each distinct digest."""
    return common.materialise(rows.groupBy("digest").agg(F.max(own_id()).alias("winner"), F.count("*").alias("size")))


def index_of(groups: DataFrame) -> tuple[DataFrame, int]:
    n_shards = max(1, -(-groups.count() // SHARD_DIGESTS))
    given = groups.select("digest", F.coalesce("winner", F.lit(0).cast("long")).alias("winner_id"), F.col("winner").isNotNull().alias("winner_named"), "size", shard_of(n_shards))
    return common.materialise(given.groupBy("shard").applyInPandas(build_shard, INDEX_SCHEMA)), n_shards


FOUND = "id long, named boolean, digest binary, salt long, known boolean, winner_id long, winner_named boolean, size long"


def look_up(key, rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Rows of one part of a shard with the winner and size of the group that its history has; known is false for nonmembers."""
    found = rows[["id", "named", "digest", "salt"]].assign(known=False, winner_id=np.int64(0), winner_named=False, size=np.int64(0)).reset_index(drop=True)
    if not len(rows) or not len(index):
        return found
    x = index.iloc[0]
    words, slots_of = as_words(rows["digest"]), as_words([x["digests"]])
    bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8)).astype(bool)[: sum(x["levels"])]
    blocks = np.frombuffer(x["ranks"], "<i8")
    inner = np.cumsum(bits) - bits
    ranks = inner - np.repeat(inner[::64], 64)[: len(bits)] + np.repeat(blocks, 64)[: len(bits)]
    slots = find_slots(words, list(x["levels"]), bits, ranks)
    member = slots >= 0
    member[member] = (slots_of[slots[member]] == words[member]).all(axis=1)  # byte by byte
    winners, sizes = np.frombuffer(x["winners"], [("named", "u1"), ("id", "<i8")]), np.frombuffer(x["sizes"], "<i8")
    at = slots[member]
    found.loc[member, "known"] = True
    found.loc[member, "winner_id"] = winners["id"][at]
    found.loc[member, "winner_named"] = winners["named"][at] > 0
    found.loc[member, "size"] = sizes[at]
    return found


def against(rows: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """(id, named, digest, salt, known, winner, size) of rows of (id, named, digest, salt), by lookups in the index."""
    sharded = rows.select("id", "named", "digest", "salt", shard_of(n_shards))
    parts = common.materialise(sharded.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")))
    salted = common.lookup(sharded, parts, "shard").withColumn("part", F.pmod(F.xxhash64("salt"), F.col("parts")).cast("int"))
    copies = common.lookup(index, parts.withColumnRenamed("shard", "of"), F.col("shard") == F.col("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("of", "parts")
    found = salted.drop("parts").groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(look_up, FOUND)
    return found.withColumn("winner", F.when(F.col("winner_named"), F.col("winner_id"))).drop("winner_id", "winner_named")


def by_group(found: DataFrame, kept=None) -> DataFrame:
    kept = own_id().eqNullSafe(F.col("winner")) if kept is None else kept
    return found.select(own_id().alias("doc_id"), F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def decide(docs: DataFrame, history: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs.

    With a history (of build_index), its members are repeats: keep_id is the history's winner and nothing is kept;
    nonmembers group among themselves. Without one, half of docs is the history of the other half, and groups are those
    of both.
    """
    rows = digests(docs)
    if history:
        found = common.materialise(against(rows, *history))
        fresh = found.filter(~F.col("known"))
        return by_group(found.filter("known"), F.lit(False)).unionByName(by_group(against(fresh, *index_of(grouped(fresh)))))
    in_past = F.pmod(F.xxhash64(own_id()), F.lit(2)) == 0
    past = grouped(rows.filter(in_past))
    found = common.materialise(against(rows.filter(~in_past), *index_of(past)))
    fresh, repeats = found.filter(~F.col("known")), found.filter("known")
    more = repeats.groupBy("digest").agg(F.max(own_id()).alias("more_winner"), F.count("*").alias("more"))
    merged = past.join(more, "digest", "left").select("digest", F.greatest("winner", "more_winner").alias("winner"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
    known = rows.filter(in_past).unionByName(repeats.select(*rows.columns))
    return by_group(against(known, *index_of(common.materialise(merged)))).unionByName(by_group(against(fresh, *index_of(grouped(fresh)))))


def deduplicated(docs: DataFrame, history: tuple[DataFrame, int] | None = None) -> DataFrame:
    """The documents that stay, one of each group of equal texts, with all their columns."""
    return common.keep_decided(docs, decide(docs, history))


def op6_exact_dedup(spark, sf_dir) -> DataFrame:
    return decide(common.table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
