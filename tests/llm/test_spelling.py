"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corrobora.llm import spelling

ASCII = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    """Whether two words differ by one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(b) > len(a) else a[k + 1 :] == b[k + 1 :]


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, all_ in others.items():
        best = min(all_, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    root = lambda w: root(form[w]) if form[w] else w
    return sorted((w, form[w] or "", root(w), n[w], len(others[w]), n[form[w]] if form[w] else -1) for w in n)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def random_docs(seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcdé"), int(k))) for k in rng.integers(4, 9, 60)] + ["Straße", "ÀÉtat", "aaaaaaaaaa", "aaaaaaaaaaa"]
    text = lambda: "".join(str(rng.choice(base)) + str(rng.choice([" ", ". ", "9", "\n"])) for _ in range(int(rng.integers(0, 60))))
    docs = [(k, text()) for k in range(80)]
    return docs + [(3, docs[4][1]), (None, docs[5][1]), (2**60 + 1, docs[5][1]), (500, None), (501, ""), (502, "x" * 5000 + " abcde" * 4000)]


def test_forms_and_roots_equal_brute_force(spark):
    for seed in range(2):
        docs = random_docs(seed)
        found = spelling.group_variants(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int"))
        assert rows_of(found) == brute(docs)


def test_signatures_find_all_near_vectors_once(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcdef"), int(k))) for k in rng.integers(5, 9, 300)})
    keyed = spark.createDataFrame([(w, 1) for w in words], "word string, n long").select(F.array_join(F.array_sort(F.split("word", "")), "").alias("v")).distinct()
    vectors = keyed.select("v", spelling.vector(F.col("v")).alias("bits"))
    found = [tuple(r) for r in spelling.near_vectors(vectors).collect()]
    letters = sorted({"".join(sorted(w)) for w in words})
    distance = lambda a, b: sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
    wanted = {(a, b) for i, a in enumerate(letters) for b in letters[i + 1 :] if distance(a, b) <= 2}
    assert len(found) == len(set(found)) and wanted <= set(found)
    assert all(distance(a, b) <= 4 for a, b in found)


def test_chains_of_forms_and_ties(spark):
    rows = [("aaaaa", 100), ("aaaab", 40), ("aaabb", 20), ("aabbb", 8), ("zzzzz", 16), ("zzzzx", 8), ("zzzzy", 8), ("zzzxz", 4)]
    docs = [(10**6, " ".join([w] * n)) for w, n in rows]
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {w: found[w] for w in ("aabbb", "aaabb", "aaaab")} == {"aabbb": ("aaabb", "aaaaa"), "aaabb": ("aaaab", "aaaaa"), "aaaab": ("aaaaa", "aaaaa")}
    assert found["zzzxz"] == ("zzzzz", "zzzzz") and found["zzzzz"] == (None, "zzzzz")


def test_empty_table(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch):
    """Spark takes any table to be small enough: no join is one by broadcast, neither of written tables nor of the result."""
    seen, write = [], spelling.common.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling.common, "materialise", lambda df: (seen.append(plan(df)), write(df))[1])
    docs = random_docs(3)
    found = spelling.group_variants(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = rows_of(found)
    seen.append(plan(found))
    assert rows == brute(docs)
    assert sum(x.count("SortMergeJoin") for x in seen) >= 6 and not any("Broadcast" in x for x in seen)
