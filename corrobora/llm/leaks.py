"""Benchmark decontamination by suffix arrays over the training texts.

The words of the documents are gathered into shards of some SHARD_WORDS words (whole texts, as a task reads them), and
each shard gets a suffix array: a first sort by as many words as fit a number, then doubling among the suffixes that
are still equal, none of which is compared beyond its text's end. Every suffix of every benchmark item is then looked
for in every shard by binary search, one word deeper each time, in the range that the words before have left. The
range at the depth of a window holds all its occurrences; the last range that isn't empty is the longest verbatim match
with its places. A text's words in occurrences of windows are hit; texts with a hit are contaminated and removed.

Nothing is shuffled: a text is judged where it is read. Items are broadcast in blocks of at most BLOCK_WORDS words. For
one block, shards are built and searched in one pass; for more, shards are written out once, each block is searched in
a pass of its own, and a text's hits meet by its place in its shard.

Defined cases: null and empty texts, and texts without words, have no words and aren't contaminated; items without
words have no window. A text longer than SHARD_WORDS words is a shard of its own, with some 60 bytes a word in memory.
Equal texts of a shard are sorted and searched once. Rows of one item_id are one item, with the windows of each; a null
item_id is an item called "null". Empty tables give no rows, or no hits. Only doc_id, text and item_id are read, so
other columns can't clash; rows that are equal in all columns all stay or all go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What stands between words: all ASCII characters but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Words of a shard, and of the items that are broadcast at once (some 60 MB).
SHARD_WORDS, BLOCK_WORDS = 2_000_000, 2_000_000

SHARD = "doc_ids array<long>, lengths array<long>, same array<long>, vocabulary array<string>, ids binary, suffixes binary"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    sums = np.concatenate(([0], np.cumsum(real)))
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return flat.filter(pa.array(real)), np.diff(sums[ends])


def suffix_array(ids: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places of ids (0 ends a text) in the order of the suffixes there; the order of those that are equal up to their texts' ends is left open. after: words from each place to the end of its text."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    depth = max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[: max(0, n - k)] |= ids[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    group = np.repeat(starts, np.diff(np.append(starts, n)))  # by place in the order: where its group of equals begins
    rank = np.empty(n, np.int64)
    rank[order] = group
    at = np.arange(n)
    while True:
        alone = np.concatenate((group[at][1:] != group[at][:-1], [True])) & np.concatenate(([True], group[at][1:] != group[at][:-1]))
        at = at[~alone & (after[order[at]] >= depth)]  # a text's end within the words that are equal settles it
        if not len(at):
            return order.astype(np.int32)
        places = order[at]
        onward = np.where(places + depth < n, rank[np.minimum(places + depth, n - 1)], -1)
        own = group[at]
        by = np.argsort(own * (n + 1) + onward + 1, kind="stable")
        places, onward = places[by], onward[by]
        # at is in order and groups are runs of it, so sorting by group leaves each group in its own places.
        order[at] = places
        fresh = np.concatenate(([True], (own[1:] != own[:-1]) | (onward[1:] != onward[:-1])))
        group[at] = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        rank[places] = group[at]
        depth *= 2


def build(doc_ids: list, texts: pa.Array) -> pa.RecordBatch:
    """One shard. lengths: words of its distinct texts. same: by document, which of these is its text."""
    coded = pc.fill_null(texts, "").dictionary_encode()
    flat, lengths = words_of(coded.dictionary)
    coded_words = flat.dictionary_encode()
    ends = np.cumsum(lengths + 1) - 1
    ids = np.zeros(int(lengths.sum()) + len(lengths), np.int32)
    inside = np.ones(len(ids), bool)
    inside[ends] = False
    ids[inside] = coded_words.indices.to_numpy() + 1
    after = np.repeat(ends, lengths + 1) - np.arange(len(ids))
    order = suffix_array(ids, after)
    columns = [[doc_ids], [lengths], [coded.indices.to_pylist()], [coded_words.dictionary.cast(pa.string()).to_pylist()], [ids.tobytes()], [order.tobytes()]]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_ids", "lengths", "same", "vocabulary", "ids", "suffixes"])


def shards(batches: Iterator[pa.RecordBatch], shard_words: int = SHARD_WORDS) -> Iterator[pa.RecordBatch]:
    """Shards of batches of (doc_id, text). A word takes six bytes or so."""
    doc_ids: list = []
    texts: list[pa.Array] = []
    size = 0
    for batch in batches:
        own, text = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for k, s in enumerate(sizes.tolist()):
            if size and size + s > 6 * shard_words:
                doc_ids += own[begin:k].to_pylist()
                texts.append(text[begin:k])
                yield build(doc_ids, pa.concat_arrays(texts))
                doc_ids, texts, size, begin = [], [], 0, k
            size += s
        doc_ids += own[begin:].to_pylist()
        texts.append(text[begin:])
    if doc_ids:
        yield build(doc_ids, pa.concat_arrays(texts))


@dataclass
class Items:
    """A block of items: their words by number (vocabulary), and each of their suffixes as a row of (start in ids, words to its end, words of its window or 0, item). names: by number of an item, in the order of strings."""

    vocabulary: list[str]
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    windows: np.ndarray
    item: np.ndarray
    names: list[str]

    @staticmethod
    def of(rows: list, window: int) -> Items:
        names = sorted({str(name) for name, _ in rows})
        number = {x: k for k, x in enumerate(names)}
        flat, counts = words_of(pa.array([text for _, text in rows], pa.string()))
        coded = flat.dictionary_encode()
        ends = np.repeat(np.cumsum(counts), counts)
        starts = np.arange(len(flat))
        left, whole = ends - starts, np.repeat(counts, counts)
        short = (whole < window) & (left == whole)
        windows = np.where(left >= window, window, np.where(short, whole, 0))
        return Items(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), starts, left, windows, np.repeat([number[str(name)] for name, _ in rows] or np.zeros(0, np.int64), counts).astype(np.int64), names)


def bound(column: np.ndarray, order: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """By query: the first place in its range [low, high) of the order whose word at the depth is at least (right: above) the wanted one."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        word = column[order[middle] + depth]
        below = word <= wanted[open_] if right else word < wanted[open_]
        low[open_[below]], high[open_[~below]] = middle[below] + 1, middle[~below]
    return low


@dataclass
class Found:
    """By suffix of the items: words of its longest match, the range of its places, and the range of its window's (empty without one)."""

    longest: np.ndarray
    low: np.ndarray
    high: np.ndarray
    window_low: np.ndarray
    window_high: np.ndarray


def search(ids: np.ndarray, order: np.ndarray, vocabulary: list[str], items: Items) -> Found:
    """Every suffix of the items in the suffix array."""
    number = {w: k + 1 for k, w in enumerate(vocabulary)}
    words = np.array([number.get(w, -1) for w in items.vocabulary] or [0], np.int64)[items.ids] if len(items.ids) else items.ids
    n = len(items.starts)
    out = Found(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(order)), np.zeros(n, np.int64), np.zeros(n, np.int64))
    live, depth = np.arange(n), 0
    low, high = out.low.copy(), out.high.copy()
    while True:
        live = live[items.lengths[live] > depth]
        live = live[words[items.starts[live] + depth] > 0]
        if not len(live):
            return out
        wanted = words[items.starts[live] + depth]
        first = bound(ids, order, depth, low[live], high[live], wanted, False)
        last = bound(ids, order, depth, first, high[live], wanted, True)
        low[live], high[live] = first, last
        live = live[last > first]
        depth += 1
        out.longest[live], out.low[live], out.high[live] = depth, low[live], high[live]
        whole = live[items.windows[live] == depth]
        out.window_low[whole], out.window_high[whole] = low[whole], high[whole]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in each range [low, high), and of which range each is."""
    counts = high - low
    which = np.repeat(np.arange(len(low)), counts)
    return np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which], which


def hits(shard: dict, items: Items) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(hit, texts): by place in the shard's ids whether a window covers it, and of the texts with hits the items whose windows they hold."""
    ids, order = np.frombuffer(shard["ids"], np.int32), np.frombuffer(shard["suffixes"], np.int32)
    found = search(ids, order, shard["vocabulary"], items)
    held = np.flatnonzero(found.window_high > found.window_low)
    # Windows of equal words have one range, which is spread once for all items.
    ranges, which = np.unique(np.stack((found.window_low[held], found.window_high[held], items.windows[held])), axis=1, return_inverse=True)
    slots, of = spread(ranges[0], ranges[1])
    places = order[slots].astype(np.int64)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + ranges[2][of], -1)
    ends = np.cumsum(np.asarray(shard["lengths"], np.int64) + 1)
    text = np.searchsorted(ends, places, "right")
    met = np.unique(text * len(ranges[0]) + of) if len(text) else np.zeros(0, np.int64)
    pairs = np.unique(np.stack((which.ravel(), items.item[held])), axis=1)
    begin, end = (np.searchsorted(pairs[0], met % max(1, len(ranges[0])), side) for side in ("left", "right"))
    k, row = spread(begin, end)
    each = np.unique(np.stack((met[row] // max(1, len(ranges[0])), pairs[1][k])), axis=1)
    cuts = np.flatnonzero(np.diff(each[0], prepend=-1))
    return np.cumsum(edges[:-1]) > 0, [(int(each[0][c]), x) for c, x in zip(cuts, np.split(each[1], cuts[1:]))] if len(cuts) else []


def digest(names) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def judge(shard: dict, items: Items) -> pa.RecordBatch:
    """(doc_id, n_words, n_hit, n_items, items_sha256) of a shard's documents."""
    hit, texts = hits(shard, items)
    lengths, same = np.asarray(shard["lengths"], np.int64), np.asarray(shard["same"], np.int64)
    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], np.cumsum(lengths + 1)))])
    n_items, sha = np.zeros(len(lengths), np.int64), [digest([])] * len(lengths)
    for text, own in texts:
        n_items[text], sha[text] = len(own), digest([items.names[i] for i in own])
    return pa.RecordBatch.from_arrays([pa.array(shard["doc_ids"], pa.int64()), pa.array(lengths[same]), pa.array(n_hit[same]), pa.array(n_items[same]), pa.array([sha[t] for t in same], pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    """The items (item_id, text) in lists of at most block_words words (or one item). They are streamed to the driver, so that it holds one block."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(r["text"] or "") // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["item_id"] if r["item_id"] is not None else "null", r["text"]))
        size += n
    yield block


def index(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards as a table: documents, words and suffix arrays."""
    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda batches: shards(batches, shard_words), SHARD)


RATED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"


def rate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    blocks = blocks_of(benchmark, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(Items.of(first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in shards(batches, shard_words):
                yield judge(batch.to_pylist()[0], shared.value)

        rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RATED)
    else:
        rated = rate_in_blocks(index(docs, shard_words), [first, second], blocks, window)
    return rated.withColumn("contaminated", F.col("n_hit") > 0)


def rate_in_blocks(shard_table: DataFrame, ready: list, rest: Iterator[list], window: int) -> DataFrame:
    """rate() with a pass over the written shards for each block of items."""
    table = common.materialise(shard_table.withColumn("shard", F.monotonically_increasing_id()))
    spark = table.sparkSession
    found = []
    for block in [*ready, *rest]:
        shared = spark.sparkContext.broadcast(Items.of(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.to_pylist():
                    hit, texts = hits(shard, shared.value)
                    begins = np.concatenate(([0], np.cumsum(np.asarray(shard["lengths"], np.int64) + 1)))
                    places = [np.flatnonzero(hit[begins[t] : begins[t + 1]]) for t, _ in texts]
                    names = [[shared.value.names[i] for i in own] for _, own in texts]
                    columns = [[shard["shard"]] * len(texts), [t for t, _ in texts], places, names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["shard", "same", "places", "names"])

        found.append(common.materialise(table.mapInArrow(run, "shard long, same long, places array<long>, names array<string>")))
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    merged = together.groupBy("shard", "same").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    rows = table.select("shard", "lengths", F.explode(F.arrays_zip("doc_ids", "same")).alias("x")).select("shard", "x.same", F.col("x.doc_ids").alias("doc_id"), F.get("lengths", F.col("x.same").cast("int")).alias("n_words"))
    joined = rows.join(merged, ["shard", "same"], "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", count("places").alias("n_hit"), count("names").alias("n_items"), F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, item_at, n_words, doc_id, doc_at): for each suffix of an item its longest verbatim match among all documents, of `least` words or more, with all its places in words; a match that begins one word earlier in both isn't listed again."""
    spark = docs.sparkSession
    shard_table = common.materialise(index(docs, shard_words))
    out = []
    for block in blocks_of(benchmark, block_words):
        items = Items.of(block, 1)
        begins = np.concatenate(([True], items.item[1:] != items.item[:-1])) if len(items.item) else np.zeros(0, bool)
        offset = np.arange(len(items.item)) - np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0)) if len(begins) else begins
        shared = spark.sparkContext.broadcast((items, offset))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, offset = shared.value
            for batch in batches:
                for shard in batch.to_pylist():
                    ids, order = np.frombuffer(shard["ids"], np.int32), np.frombuffer(shard["suffixes"], np.int32)
                    found = search(ids, order, shard["vocabulary"], items)
                    long = np.flatnonzero(found.longest >= least)
                    slots, which = spread(found.low[long], found.high[long])
                    places, suffix = order[slots].astype(np.int64), long[which]
                    ends = np.cumsum(np.asarray(shard["lengths"], np.int64) + 1)
                    text = np.searchsorted(ends, places, "right")
                    begin = np.concatenate(([0], ends[:-1]))[text]
                    by_text = np.argsort(np.asarray(shard["same"]), kind="stable")
                    same = np.asarray(shard["same"])[by_text]
                    k, row = spread(np.searchsorted(same, text, "left"), np.searchsorted(same, text, "right"))
                    docs_ = [shard["doc_ids"][i] for i in by_text[k]]
                    columns = [[items.names[i] for i in items.item[suffix[row]]], offset[suffix[row]], found.longest[suffix[row]], docs_, (places - begin)[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["item_id", "item_at", "n_words", "doc_id", "doc_at"])

        out.append(shard_table.mapInArrow(run, "item_id string, item_at long, n_words long, doc_id long, doc_at long"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    rows = common.materialise(rows)
    best = rows.groupBy("item_id", "item_at").agg(F.max("n_words").alias("n_words"))
    top = rows.join(best, ["item_id", "item_at", "n_words"])
    earlier = top.select("item_id", (F.col("item_at") + 1).alias("item_at"), (F.col("n_words") - 1).alias("n_words"), "doc_id", (F.col("doc_at") + 1).alias("doc_at"))
    return top.join(earlier, ["item_id", "item_at", "n_words", "doc_id", "doc_at"], "left_anti")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs
    for block in blocks_of(benchmark, BLOCK_WORDS):
        shared = spark.sparkContext.broadcast(Items.of(block, WINDOW))

        @F.pandas_udf("boolean")
        def clean(texts, shared=shared):
            import pandas as pd

            out = [np.zeros(0, bool)]
            for batch in shards(iter([pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string(), from_pandas=True)], ["doc_id", "text"])])):
                out.append(judge(batch.to_pylist()[0], shared.value).column("n_hit").to_numpy() == 0)
            return pd.Series(np.concatenate(out))

        kept = kept.filter(clean(F.col("text").cast("string")))
    return kept


def op11_leaks(spark, sf_dir) -> DataFrame:
    return rate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}'), lambda x: x <> '') AS w FROM benchmark),
    i AS (SELECT DISTINCT item, m, list_slice(w, p + 1, p + m) AS win FROM (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(greatest(0, len(w) - least(len(w), {WINDOW}) + 1))) AS p FROM b WHERE len(w) > 0)),
    g AS (SELECT r, p, m, list_slice(w, p + 1, p + m) AS win FROM (SELECT r, w, m, unnest(range(greatest(0, len(w) - m + 1))) AS p FROM d, (SELECT DISTINCT m FROM i))),
    o AS (SELECT r, p, g.m, item FROM g JOIN i ON g.win = i.win),
    h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS k FROM o) GROUP BY r),
    n AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""
