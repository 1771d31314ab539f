"""Quality rules with suffix-array repetition.

The words of a text are numbered and their suffix array is built by prefix doubling: the rank of each suffix by its
first 1, 2, 4, ... words. The kept ranks give the longest common prefix of neighbours in the array from the highest
power down. Neighbours that share m words make an LCP interval: a repeated substring with all its places. Intervals
nest, and the innermost around a suffix is as deep as the larger of the common prefixes with its two neighbours: that
is the longest repeated substring that starts there. The union of the spans of all maximal repeats is the union of
these, so intervals aren't listed (a text of one repeated word has as many as words, nested): the shares of words that
repeats of certain lengths and more cover, and the longest, are limited. Both passes are sorts and comparisons of
whole numpy arrays, and cover the whole text.

Defined cases: null and empty texts have no words, no repeats, fail the base rule (fewer than 20 words) and aren't
kept; very long texts are rated whole, with some 40 bytes a word and power of two up to the longest repeat in memory;
texts in which every word is the same are covered wholly. Equal texts get equal results; a null doc_id is kept. An
empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Symbols that the base counts.
SYMBOLS = "#*$%&|<>"
#: Words in a window of the base's repeat count.
WINDOW = 8
#: The base's limits: fewest words, most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The method's limits: (words of a repeat worth counting, largest share of words that such repeats cover), the first of which gives n_covered; words of the longest.
MOST_COVERED, LONGEST_REPEAT = ((5, 0.5), (12, 0.2)), 50

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long, longest_at long"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the suffixes in order, and the words that each shares with the one before (0 for the first)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(ids, return_inverse=True)
    ranks, step, distinct = [rank.astype(np.int32)], 1, int(rank.max()) + 1
    while distinct < n:
        pair = rank.astype(np.int64) * (n + 1)
        pair[: n - step] += rank[step:] + 1  # past the end: 0, before all words
        _, rank = np.unique(pair, return_inverse=True)
        distinct = int(rank.max()) + 1
        ranks.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right, shared = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for power in range(len(ranks) - 1, -1, -1):
        i, j = left + shared, right + shared
        inside = np.flatnonzero(np.maximum(i, j) < n)
        equal = inside[ranks[power][i[inside]] == ranks[power][j[inside]]]
        shared[equal] += 1 << power
    return order, np.concatenate(([0], shared))


def longest_from(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """By position: words of the longest substring that starts there and occurs elsewhere too."""
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest


def covered(starts: np.ndarray, lengths, n: int) -> int:
    """Positions in the union of spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The counts of one text, without doc_id."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    longest = longest_from(*suffix_array(ids))
    windows = np.flatnonzero(longest >= WINDOW)
    n_repeat = covered(windows, WINDOW, n) if len(windows) else 0
    in_repeats = []
    for least, _ in MOST_COVERED:
        spans = np.flatnonzero(longest >= least)
        in_repeats.append(covered(spans, longest[spans], n) if len(spans) else 0)
    top = int(longest.max()) if n else 0
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            lines.add(line)
    failed = n < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n
    kept = not failed and all(c <= share * n for c, (_, share) in zip(in_repeats, MOST_COVERED)) and top <= LONGEST_REPEAT
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, n_repeat, failed, kept, in_repeats[0], top, int(longest.argmax()) if top else -1


def rate(docs: DataFrame) -> DataFrame:
    """The base counts, the verdicts, and the covered words, longest repeat and its first word's place, by document."""
    common.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=names)

    return docs.select("doc_id", run(F.col("text").cast("string")).alias("out")).select("doc_id", "out.*")


def op10_quality(spark, sf_dir) -> DataFrame:
    return rate(common.table(spark, sf_dir, "documents"))
