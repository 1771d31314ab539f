"""Benchmark decontamination against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from corrobora.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def brute(docs, items, window):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by comparing all windows."""
    wins = set()
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        wins |= {("null" if item is None else str(item), tuple(w[p : p + m])) for p in range(len(w) - m + 1) if m}
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    held.add(item)
        out.append((doc_id, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def random_rows(seed, n_docs=40):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(["a", "B", "c,d", "É", "1"], n))
    docs = [(k, text(int(rng.integers(0, 60)))) for k in range(n_docs)]
    docs += [(7, docs[3][1]), (None, docs[5][1]), (2**60 + 1, docs[5][1]), (900, None), (901, ""), (902, " .,- "), (903, "a " * 3000)]
    items = [(k, text(int(rng.integers(3, 14)))) for k in range(6)] + [(20, "a B"), (21, ""), (22, None), (None, "1 1"), (2, "É"), (10, "zz a")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_hits_equal_those_of_all_windows(spark, seed):
    docs, items = random_rows(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    expect = brute(docs, items, 5)
    for sizes in ({}, {"shard_words": 20}, {"shard_words": 50, "block_words": 6}):
        assert sorted((tuple(r) for r in leaks.rate(d, b, 5, **sizes).collect()), key=repr) == expect


def test_suffixes_are_in_order():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["x", "y"], int(n))) for n in rng.integers(0, 40, 30)]
    shard = leaks.build(list(range(30)), pa.array(texts)).to_pylist()[0]
    ids, order = np.frombuffer(shard["ids"], np.int32).tolist(), np.frombuffer(shard["suffixes"], np.int32).tolist()
    assert sorted(order) == list(range(len(ids)))
    suffix = lambda i: ids[i : ids.index(0, i)]
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(len(ids)))


def test_longest_matches_and_their_places(spark):
    docs = spark.createDataFrame([(1, "q a b c d e r"), (2, "a b c d"), (3, "z a b c d e"), (4, "q a b c d e r"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "x a b c d e y b c d z"), (8, "none of it")], "item_id long, text string")
    rows = {tuple(r) for r in leaks.longest_matches(docs, items, 3, shard_words=4).collect()}
    assert {r for r in rows if r[1] == 1} == {("9", 1, 5, 1, 1), ("9", 1, 5, 3, 1), ("9", 1, 5, 4, 1)}
    assert {r for r in rows if r[1] == 7} == {("9", 7, 3, 1, 2), ("9", 7, 3, 2, 1), ("9", 7, 3, 3, 2), ("9", 7, 3, 4, 2)}
    assert {r[1] for r in rows} == {1, 7}


def test_affected_documents_go_whole(spark):
    leak = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"so {leak.upper()}!", "a"), (2, "clean", "b"), (2, "clean", "b"), (3, None, None)], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted((tuple(r) for r in leaks.decontaminated(docs, items).collect()), key=repr) == [(2, "clean", "b"), (2, "clean", "b"), (3, None, None)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in leaks.rate(docs, items).collect()] == [(1, 2, 0, 0)]
    assert leaks.rate(docs.limit(0), items).count() == 0 == leaks.longest_matches(docs, items).count()
    assert leaks.decontaminated(docs, items).count() == 1
