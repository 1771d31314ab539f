"""Components by contraction, interval labels, pairs at their first common ancestor: against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import entities, graph, intervals
from corrobora.operators import ontology as O


def random_edges(seed, n=40, most=3):
    r = random.Random(seed)
    return sorted({(f"t{i:02}", f"t{r.randrange(i):02}") for i in range(1, n) for _ in range(r.randint(1, most))}) + [("x", "y")]


def ancestors(edges):
    out = {x: {x} for e in edges for x in e}
    while True:
        before = sum(map(len, out.values()))
        for child, parent in edges:
            out[child] |= out[parent]
        if sum(map(len, out.values())) == before:
            return out


@pytest.mark.parametrize("seed", range(3))
def test_labels_count_what_is_below(spark, seed):
    edges = random_edges(seed)
    labels = intervals.label(spark.createDataFrame([*edges, *edges[:3], (None, "t01"), ("t01", None), ("t05", "t05")], "child string, parent string"))
    above = ancestors(edges)
    below = {x: {y for y in above if x in above[y]} for x in above}
    assert {r["id"]: r["n"] for r in intervals.counts_below(labels).collect()} == {x: len(y) for x, y in below.items()}
    for root in ("t00", "t03", "x", "y"):
        assert {r["id"] for r in intervals.descendants(labels, root).collect()} == below[root]
    assert [r["id"] for r in intervals.descendants(labels, "none").collect()] == ["none"]


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_by_number(spark, seed):
    edges = random_edges(seed)
    names, above = graph.ancestors(spark.createDataFrame([*edges, *edges[:3], (None, "t01"), ("t01", None), ("t05", "t05")], "child string, parent string"))
    of = {r["number"]: r["id"] for r in names.collect()}
    found = {of[r["number"]]: [of[x] for x in r["above"]] for r in above.collect()}
    assert {x: sorted(up) for x, up in found.items()} == {x: sorted(up) for x, up in ancestors(edges).items()}


def test_ancestors_of_a_chain_and_a_cycle(spark):
    edges = [*((f"c{i}", f"c{i - 1}") for i in range(1, 70)), ("c5", "c1"), ("k1", "k2"), ("k2", "k3"), ("k3", "k1")]
    names, above = graph.ancestors(spark.createDataFrame(edges, "child string, parent string"))
    sizes = {r["id"]: r["n"] for r in above.join(names, "number").select("id", F.size("above").alias("n")).collect()}
    assert sizes == {f"c{i}": i + 1 for i in range(70)} | {"k1": 3, "k2": 3, "k3": 3}


def test_ancestors_ask_only_nodes_at_the_last_distance(spark, monkeypatch):
    """In a ladder all nodes below are ancestors over many ways; a doubled closure meets each pair once for each node between."""
    asked, write = [], graph.materialise_with
    monkeypatch.setattr(graph, "materialise_with", lambda df, **m: (lambda out: (asked.append(out[0].agg(F.sum(F.size("far"))).first()[0]), out)[1])(write(df, **m)))
    graph.ancestors(spark.createDataFrame([(f"c{i:02}", f"c{i - k:02}") for i in range(3, 64) for k in (1, 2, 3)], "child string, parent string"))
    assert max(asked) <= 3 * 64


def test_a_chain_takes_a_row_a_node(spark):
    n = 20_000
    chain = spark.range(1, n).select(F.concat(F.lit("c"), "id").alias("child"), F.concat(F.lit("c"), F.col("id") - 1).alias("parent"))
    labels = intervals.label(chain)
    assert labels.nodes.count() == n and labels.extra.count() == 0
    below = intervals.counts_below(labels)
    assert below.filter(F.col("n") != n - F.substring("id", 2, 9).cast("long")).count() == 0
    assert intervals.information_content(labels).filter("id = 'c10000'").first()["ic"] == pytest.approx(math.log(2))


def test_descendants_follow_one_roots_intervals(spark, monkeypatch):
    edges = random_edges(7)
    labels = intervals.label(spark.createDataFrame(edges, "child string, parent string"))
    monkeypatch.setattr(intervals, "further", None)
    above = ancestors(edges)
    assert {r["id"] for r in intervals.descendants(labels, "t02").collect()} == {x for x in above if "t02" in above[x]}


@pytest.mark.parametrize("top_edges", [10, 5_000])
def test_counts_below_hand_points_down(spark, monkeypatch, top_edges):
    """Halves and thirds, nodes without such edges below them, a cycle over an edge that the forest leaves out and nodes on both sides of it; no node's further intervals are made."""
    for name, value in (("TOP_EDGES", top_edges), ("SUM_BITS", 3), ("further", None)):
        monkeypatch.setattr(intervals, name, value, raising=False)
    edges = [(f"X:{p}", f"X:{p // k}") for p in range(2, 120) for k in (2, 3) if p >= k]
    edges += [(f"c{i}", f"c{i - 1}") for i in range(1, 9)] + [("c0", "X:77"), ("c5", "X:64")]
    edges += [("a", "a0"), ("a", "b"), ("b", "a"), ("a0", "X:5"), ("a0", "X:7"), ("d", "b"), ("d", "X:9"), ("e", "d")]
    above = ancestors(sorted(set(edges)))
    labels = intervals.label(spark.createDataFrame(edges, "child string, parent string"))
    assert {r["id"]: r["n"] for r in intervals.counts_below(labels).collect()} == {x: sum(x in y for y in above.values()) for x in above}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        intervals.label(spark.createDataFrame([("b", "c"), ("c", "b"), ("a", "r")], "child string, parent string"))


def test_points_are_found_in_intervals_once(spark):
    r = random.Random(4)
    spans = [(k, *sorted((r.randrange(70), r.randrange(70)))) for k in range(60)]
    points = [(f"p{k}", r.randrange(64)) for k in range(40)]
    found = intervals.points_within(spark.createDataFrame(points, "p string, point long"), spark.createDataFrame(spans, "k int, low long, high long"), 7)
    assert sorted((x["p"], x["k"]) for x in found.collect()) == sorted((p, k) for p, at in points for k, low, high in spans if low <= at < high)


@pytest.mark.parametrize("seed, block", [(0, 2000), (1, 3)])
def test_pairs_meet_at_the_most_informative_ancestor(spark, monkeypatch, seed, block):
    monkeypatch.setattr(O, "BLOCK_TERMS", block)
    edges = random_edges(seed)
    above = ancestors(edges)
    ic = {x: -math.log(sum(x in y for y in above.values()) / len(above)) for x in above}
    top = max(ic.values())

    def near(a, b):
        m = max((ic[x] for x in above[a] & above[b]), default=None)
        return None if m is None else ((2 * m / (ic[a] + ic[b]) if ic[a] + ic[b] > 0 else 0) + m / top) / 2

    df = spark.createDataFrame(edges, "child string, parent string")
    queries = [x for i, x in enumerate(sorted(above)) if i % 5 == 0]
    rows = O.similarity_rows(df, spark.createDataFrame([(x,) for x in queries], "id string")).collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    assert {(r[0], r[1]): pytest.approx(r[2]) for r in rows} == {(a, b): 1 if a == b else near(a, b) for a in queries for b in above if above[a] & above[b]}
    found = {(r[0], r[1]): r[2] for r in O.semantic_similarity(df, 0.4).collect()}
    assert found == {(a, b): pytest.approx(1 if a == b else near(a, b)) for a in above for b in above if a == b or (near(a, b) or 0) >= 0.4}


def test_rows_of_the_matrix_are_small_and_no_block_is_repeated(spark, tmp_path):
    """Rows take under six bits each in a file, and blocks meet where they are read: what is shuffled doesn't grow with the pairs of blocks."""
    n = 4000
    edges = spark.range(2, n).selectExpr("'X:' || id AS child", "'X:' || CAST(floor(id / 2) AS BIGINT) AS parent").union(spark.range(3, n).selectExpr("'X:' || id", "'X:' || CAST(floor(id / 3) AS BIGINT)"))
    found = O.similarity_rows(edges, spark.range(0, n, 20).selectExpr("'X:' || id AS id"))
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    found.write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == (n - 1) * (n // 20 - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n * n / 20 * 6 / 8


def test_ancestors_that_cannot_reach_the_threshold_are_not_listed(spark, monkeypatch):
    """Lists of earlier ancestors are written for rows that can reach the threshold alone; rows of the whole matrix need none."""
    listed, write = [], O.materialise

    def counted(df):
        out = write(df)
        listed.extend([out.agg(F.sum(F.size("before"))).first()[0] or 0] if "before" in out.columns else [])
        return out

    monkeypatch.setattr(O, "materialise", counted)
    chain = spark.createDataFrame([(f"c{i:03}", f"c{i - 1:03}") for i in range(1, 100)], "child string, parent string")
    assert O.semantic_similarity(chain, 0.85).count() > 100
    assert sum(listed) < 100 * 100 / 2
    listed.clear()
    assert O.similarity_rows(chain, chain.select(F.col("child").alias("id")).limit(7)).count() == 7 * 100
    assert not listed


def test_blocks_of_separate_trees_and_shared_descendants(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_TERMS", 4)
    monkeypatch.setattr(O, "BATCH_PAIRS", 5)
    edges = [(f"{t}{i}", f"{t}{(i - 1) // 2}") for t in "abcdef" for i in range(1, 9)] + [("a7", "b2"), ("c8", "b1"), ("k1", "k2"), ("k2", "k1"), ("k3", "k1"), ("s", "s")]
    above = ancestors(edges)
    df = spark.createDataFrame(edges, "child string, parent string")
    rows = O.similarity_rows(df, df.select(F.col("child").alias("id"))).collect()
    asked = {c for c, _ in edges}
    assert sorted((r[0], r[1]) for r in rows) == sorted((a, b) for a in asked for b in above if above[a] & above[b])
    found = O.semantic_similarity(df, 0.0).collect()
    assert sorted((r[0], r[1]) for r in found) == sorted((a, b) for a in above for b in above if above[a] & above[b])


def test_components_shrink(spark, monkeypatch):
    sizes = []
    write = graph.materialise_with

    def counted(df, **metrics):
        out, seen = write(df, **metrics)
        sizes.extend([seen["n"]] if "n" in seen else [])
        return out, seen

    monkeypatch.setattr(graph, "materialise_with", counted)
    r = random.Random(6)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(380)] + [(1000, 1000), (None, 5), (7, None), *[(2000, 3000 + k) for k in range(300)], *[(k, k + 1) for k in range(5000, 5100)]]
    found = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in label:
        if all(label[a] == label[b] for a, b in edges if None not in (a, b)):
            break
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert sizes[-1] == 0 and all(b < a / 2 for a, b in zip(sizes, sizes[1:]))


def test_a_hub_is_one_component(spark):
    edges = spark.range(200_000).select(F.lit(10**6).alias("a"), F.col("id").alias("b"))
    out = graph.components(edges)
    assert out.count() == 200_001 and out.filter("label <> 0").count() == 0


def test_identities_write_only_what_hangs_together(spark, monkeypatch):
    """Records with one identifier make no edge, so none of them is written, grouped or followed; membership has the clusters of the records."""
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: (lambda out: (written.append(out.count()), out)[1])(write(df)))
    monkeypatch.setattr(graph, "materialise_with", lambda df, **m: (lambda out: (out, out.agg(*[c.alias(n) for n, c in m.items()]).first().asDict()))(graph.materialise(df)))
    rows = [(k, f"C{k}", None, " ", None) for k in range(100)] + [(100, "C3", "D1", None, None), (101, None, "D1", "n", None), (102, None, None, "n", "S"), (103, None, "D2", None, "S2"), (104, "", None, None, None)]
    df = spark.createDataFrame(rows, "record_id int, chembl_id string, drugbank_id string, drug_name_normalized string, stitch_id string")
    found = {r["record_id"]: r["drug_cluster"] for r in entities.connected_entities(df).collect()}
    assert max(written) <= 4
    assert found == {k: f"chembl_id:C{k}" for k in range(100)} | dict.fromkeys((100, 101, 102), "chembl_id:C3") | {103: "drugbank_id:D2", 104: "record:104"}
    members = sorted(tuple(r) for r in entities.membership(df).collect())
    kinds = ("chembl_id", "drugbank_id", "drug_name_normalized", "stitch_id")
    assert members == sorted({(c, x, found[r[0]]) for r in rows for c, x in zip(kinds, r[1:]) if x and x.strip()})
