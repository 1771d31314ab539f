"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours and a group of copies is split only where
a boundary falls inside it. For each boundary between shards the wanted number of bytes below it is known; candidate
keys (probes) are laid through the interval in which it lies, every partition sums the bytes of its rows between
probes, and the sums, which are exact, narrow the interval down. It ends when what is left in the interval is one row
or within the tolerance; the nearer end becomes the splitter. A hash that is too heavy (a hot group) is refined by
doc_id in the same way. Then the rows are exchanged once, by the parts that the splitters make, and sorted in them;
counts from the histograms give each part's first slot. Shards of more than PART_ROWS rows are made of several parts,
so no task holds a whole shard at scale.

The law is `bytes`: shard sizes are as near to equal as whole rows and the tolerance allow. The driver sees sums for
probes, whose number depends on the number of parts alone.

Defined cases: null text has no bytes and the checksum of the empty text; a null doc_id sorts first; a text larger than
a shard's share stays whole, and shards beside it may be empty; rows that agree in text and doc_id aren't separated;
with fewer rows than shards some shards are empty, as all are for an empty table.
Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Bytes that a row costs besides its text.
ROW_BYTES = 8
#: A splitter may miss its mark by this share of a shard; one inside a shard by this share of a part.
TOLERANCE, INNER_TOLERANCE = 0.001, 0.25
PART_ROWS = 2_000_000
#: Probes for each open boundary in a round, and for all of them at most (but 2 each).
PROBES, ALL_PROBES = 64, 100_000
LOW, HIGH = -(2**63), 2**63


@dataclass
class Boundary:
    """A wanted number of bytes, and the interval [low, high) of keys where it is passed, with the bytes and rows below its ends. heavy: the hash within which doc_ids are now searched."""

    wanted: float
    tolerance: float
    low: int = LOW
    high: int = HIGH
    below: tuple[int, int] = (0, 0)
    upto: tuple[int, int] = (0, 0)
    heavy: int | None = None
    done: bool = False
    splitter: tuple[int, int] = (LOW, LOW)
    counts: tuple[int, int] = (0, 0)

    def probes(self, n: int) -> list[int]:
        """The ends of the interval, and keys between them."""
        width = self.high - self.low
        return [p for i in range(n + 2) if LOW < (p := self.low + width * i // (n + 1)) < HIGH]

    def close(self) -> None:
        nearer_low = self.wanted - self.below[0] <= self.upto[0] - self.wanted
        key, self.counts = (self.low, self.below) if nearer_low else (self.high, self.upto)
        key = min(key, HIGH - 1)
        self.splitter, self.done = ((key, LOW) if self.heavy is None else (self.heavy, key)), True


@dataclass
class Histogram:
    """Sums between probes: bytes, rows, least and greatest key of each bucket; bucket i holds keys from probe i - 1 to before probe i."""

    probes: list[int]
    sums: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)
    ends: tuple | None = None

    def upto(self) -> tuple[np.ndarray, ...]:
        """Of the buckets that hold rows: bytes and rows up to the end of each, least and greatest keys. Summed once for all boundaries of a round."""
        if self.ends is None:
            each = np.array([self.sums[i] for i in sorted(self.sums)], dtype=np.int64).reshape(-1, 4)
            self.ends = (np.cumsum(each[:, 0]), np.cumsum(each[:, 1]), each[:, 2], each[:, 3])
        return self.ends

    def narrow(self, b: Boundary, base: tuple[int, int]) -> None:
        """Moves b's interval to the bucket in which its mark is passed. base: bytes and rows below all keys of this histogram."""
        sizes, rows, least, most = self.upto()
        if len(sizes):
            k = min(int(np.searchsorted(sizes, b.wanted - base[0], "left")), len(sizes) - 1)
            b.below = (base[0] + int(sizes[k - 1]), base[1] + int(rows[k - 1])) if k else base
            b.upto = (base[0] + int(sizes[k]), base[1] + int(rows[k]))
            b.low, b.high = int(least[k]), int(most[k]) + 1


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h, id) of each row, written out for the rounds."""
    text = common.text_or_empty()
    return common.materialise(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), sort_id().alias("id")))


def sort_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))


def count_between(rows: DataFrame, first: list[int], inner: dict[int, list[int]]) -> tuple[Histogram, dict[int, Histogram]]:
    """Histograms by hash, and by doc_id within each heavy hash."""
    outer_probes = np.array(first, dtype=np.int64)
    inner_probes = {g: np.array(p, dtype=np.int64) for g, p in inner.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, int], list] = {}

        def add(which: int, probes: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> None:
            bucket = np.searchsorted(probes, keys, side="right")
            order = np.argsort(bucket, kind="stable")
            bucket, keys, sizes = bucket[order], keys[order], sizes[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            if len(at):
                for i, s, n, lo, hi in zip(bucket[at].tolist(), np.add.reduceat(sizes, at).tolist(), np.diff(at, append=len(bucket)).tolist(), np.minimum.reduceat(keys, at).tolist(), np.maximum.reduceat(keys, at).tolist()):
                    x = found.setdefault((which, i), [0, 0, lo, hi])
                    x[0], x[1], x[2], x[3] = x[0] + s, x[1] + n, min(x[2], lo), max(x[3], hi)

        for pdf in batches:
            h, ids, sizes = (pdf[c].to_numpy(np.int64) for c in ("h", "id", "size"))
            add(-1, outer_probes, h, sizes)
            for k, (g, probes) in enumerate(inner_probes.items()):
                heavy = h == g
                add(k, probes, ids[heavy], sizes[heavy])
        yield pd.DataFrame([(*k, *x) for k, x in found.items()], columns=["which", "bucket", "size", "n", "lo", "hi"])

    sums = rows.select("h", "id", "size").mapInPandas(run, "which int, bucket int, size long, n long, lo long, hi long")
    sums = sums.groupBy("which", "bucket").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    outer, heavy = Histogram(first), {g: Histogram(p) for g, p in inner.items()}
    by_number = dict(enumerate(heavy.values()))
    for r in sums.collect():
        (outer if r["which"] < 0 else by_number[r["which"]]).sums[r["bucket"]] = (r["size"], r["n"], r["lo"], r["hi"])
    return outer, heavy


def find_splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_rows: int = PART_ROWS) -> tuple[list[Boundary], int]:
    """Closed boundaries in order, and the number of parts in each shard."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return [], 1
    parts = max(1, -(-n // (shards * part_rows)))
    share = total / (shards * parts)
    bounds = [Boundary(share * k, tolerance * share * parts if k % parts == 0 else INNER_TOLERANCE * share, upto=(total, n)) for k in range(1, shards * parts)]
    bases: dict[int, tuple[int, int]] = {}  # bytes and rows below each heavy hash
    while open_ones := [b for b in bounds if not b.done]:
        each = max(2, min(PROBES, ALL_PROBES // len(open_ones)))
        first = sorted({p for b in open_ones if b.heavy is None for p in b.probes(each)})
        inner: dict[int, set[int]] = {}
        for b in open_ones:
            if b.heavy is not None:
                inner.setdefault(b.heavy, set()).update(b.probes(each))
        outer, heavy = count_between(rows, first, {g: sorted(p) for g, p in inner.items()})
        for b in open_ones:
            if b.heavy is None:
                outer.narrow(b, (0, 0))
            else:
                heavy[b.heavy].narrow(b, bases[b.heavy])
            left = (b.upto[0] - b.below[0], b.upto[1] - b.below[1])
            single = b.high - b.low <= 1
            if left[1] <= 1 or left[0] <= b.tolerance or (single and b.heavy is not None):
                b.close()
            elif single:
                b.heavy, bases[b.low] = b.low, b.below
                b.low, b.high = LOW, HIGH
    return sorted(bounds, key=lambda b: b.splitter), parts


def part_of(splitters: list[tuple[int, int]]):
    """A column function of (h, id): the number of splitters at or below the key."""
    hs, ids = (np.array([s[k] for s in splitters], dtype=np.int64) for k in (0, 1))

    @F.pandas_udf("int")
    def run(h: pd.Series, doc_id: pd.Series) -> pd.Series:
        key, own = h.to_numpy(np.int64), doc_id.to_numpy(np.int64)
        part, upto = np.searchsorted(hs, key, "left"), np.searchsorted(hs, key, "right")
        for g in np.unique(key[part < upto]):
            here = key == g
            a, b = np.searchsorted(hs, g, "left"), np.searchsorted(hs, g, "right")
            part[here] = a + np.searchsorted(ids[a:b], own[here], "right")
        return pd.Series(part.astype(np.int32))

    return run


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    rows = measured(docs)
    bounds, parts = find_splitters(rows, shards)
    before = [0, *(b.counts[1] for b in bounds)]  # rows before each part
    first_slot = [n - before[k - k % parts] for k, n in enumerate(before)]
    placed = rows.withColumn("part", part_of([b.splitter for b in bounds])("h", "id")) if bounds else rows.withColumn("part", F.lit(0))
    number = F.row_number().over(Window.partitionBy("part").orderBy("h", "id", "size", "text_crc32"))
    start = F.element_at(F.array(*[F.lit(x) for x in first_slot]), F.col("part") + 1) if len(first_slot) <= 4096 else None
    if start is None:
        starts = docs.sparkSession.createDataFrame(list(enumerate(first_slot)), "part int, start long")
        placed, start = placed.join(F.broadcast(starts), "part"), F.col("start")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("part") / parts).cast("int").alias("shard"), (start + number - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents, all columns, to folders shard=0, 1, ..., in key order: whole rows are exchanged once."""
    bounds, parts = find_splitters(measured(docs), shards)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(common.text_or_empty()).alias("h"), sort_id().alias("id"))
    placed = keyed.withColumn("part", part_of([b.splitter for b in bounds])("h", "id")) if bounds else keyed.withColumn("part", F.lit(0))
    dealt = placed.repartition(shards * parts, "part").sortWithinPartitions("part", "h", "id")
    dealt.select("row", F.floor(F.col("part") / parts).cast("int").alias("shard")).write.partitionBy("shard").parquet(path)


def op8_sharding(spark, sf_dir) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents"))
