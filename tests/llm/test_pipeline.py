"""The pipeline's stages against brute force on a small corpus, and its queries' registration."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corrobora.llm import mixing, simhash, toxicity
from corrobora.llm.queries import QUERIES, SQL

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, path = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    word = lambda: f"w{rng.randrange(900)}"
    texts = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(500)]
    for i in range(0, 500, 5):
        texts[i] += " vile rotten filthy"
    texts += [texts[1]] * 30 + [" ".join(word() for _ in range(300)) + f" end{k % 2}" for k in range(1) for _ in range(4)]
    base = " ".join(word() for _ in range(600))
    texts += [base, base + " x", base + " y", None, "", ""]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 500, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    columns, kept = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources", "byte-level BPE"]

    toxic = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 1").collect()}
    assert {i for i in range(0, 500, 5)} <= toxic
    docs = stages["toxicity"](spark, docs, path)
    kept["toxicity"] = sorted(r["doc_id"] for r in docs.collect())
    assert kept["toxicity"] == sorted(i for i, *_ in rows if i not in toxic)

    best = {}
    for i, t, *_ in rows:
        if i not in toxic:
            best[t or ""] = max(best.get(t or "", -1), i)
    docs = stages["exact dedup"](spark, docs, path)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(best.values())

    names = simhash.near_duplicates(docs).collect()
    fps = [(r["doc_id"], int(r["fingerprint"], 16)) for r in names]
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if bin(x ^ y).count("1") <= 4:
                assert len({r["component_id"] for r in names if r["doc_id"] in (a, b)}) == 1
    docs = stages["SimHash near-dedup"](spark, docs, path)
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in names})

    copies = {r["doc_id"]: r["n_copies"] for r in mixing.mix(docs).collect()}
    mixed = stages["mixing sources"](spark, docs, path)
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    assert mixed.columns == columns

    last = stages["byte-level BPE"](spark, mixed, path).collect()
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(repr, last)) == sorted(map(repr, whole)) and len(last) == sum(copies.values())


def test_stages_of_an_empty_table(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_extra_columns_go_through(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(1) for c in ("size", "h", "label", "kept", "row", "fp", "copies")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns


def test_registration():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)
