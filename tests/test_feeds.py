import os

import pytest
from pyspark.sql import functions as F

from corrobora.operators import aggregate as A
from corrobora.operators import entities, graph
from corrobora.operators import ontology as O
from corrobora.sources import evidence as V
from corrobora.sources import scans
from corrobora.sources import status as S
from corrobora.sources import trials as N


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.format_string("n%04d", "id").alias("a"), F.format_string("n%04d", F.col("id") + 1).alias("b"))
    out = graph.components(chain)
    assert out.count() == 201 and out.select("label").distinct().collect()[0][0] == "n0000"


def test_records_without_identifiers_stay_alone(spark):
    rows = [(1, "C1", None, "aspirin", None), (2, None, "D1", "aspirin", None), (3, " ", None, None, ""), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id int, chembl_id string, drugbank_id string, drug_name_normalized string, stitch_id string")
    out = {r["record_id"]: r["drug_cluster"] for r in entities.connected_entities(df).collect()}
    assert out[1] == out[2] == "chembl_id:C1" and out[3] == "record:3" and out[4] == "record:4"


def test_replacements(spark):
    live = spark.createDataFrame([("L1",), ("L2",)], "id string")
    hops = [("A", "L1"), ("B", "A"), ("C", "D"), ("D", "C"), ("E", "L1"), ("E", "L2"), ("F", "L1"), ("F", "X"), ("G", "X"), ("L2", "L1")]
    out = O.resolve_replacements(live, spark.createDataFrame(hops, "id string, successor string"))
    assert {tuple(r) for r in out.collect()} == {("A", "L1"), ("B", "L1"), ("F", "L1")}


def test_remap(spark):
    df = spark.createDataFrame([("L1", "x"), ("A", "y"), ("G", "z"), ("new", "u"), (None, "v")], "efo_id string, efo_term string")
    hops, gone, names = (spark.createDataFrame(r, s) for r, s in (([("A", "L1")], "id string, successor string"), ([("A",), ("G",)], "id string"), ([("L1", "Name")], "id string, name string")))
    out = {tuple(r) for r in O.remap(df, hops, gone, labels=names, label="efo_term").collect()}
    assert out == {("L1", "x"), ("L1", "Name"), ("new", "u"), (None, "v")}


def test_terms(spark):
    text = "[Term]\nid: EFO:1\nname: a: b\nis_a: EFO:2 {s=1} ! two\nis_a: EFO:3", "[Typedef]\nid: part_of", "format-version: 1.2\ndata-version: http://x/v3.90.0/efo.owl"
    df = spark.createDataFrame([(t,) for t in text], "value string")
    row = O.parse_terms(df).collect()
    assert len(row) == 1 and row[0]["name"] == "a: b" and row[0]["is_a"] == ["EFO:2", "EFO:3"] and not row[0]["is_obsolete"]
    assert O.ontology_version(df).first()[0] == "3.90.0"


def test_similarity_prune_loses_nothing(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k // d}") for k in range(2, 40) for d in (2, 3) if k // d], "child string, parent string")
    full = {(r[0], r[1]): r[2] for r in O.semantic_similarity(edges, 0.0).collect()}
    some = {(r[0], r[1]): r[2] for r in O.semantic_similarity(edges, 0.5).collect()}
    assert some == pytest.approx({k: v for k, v in full.items() if v >= 0.5 or k[0] == k[1]})


def test_gwas_thresholds_and_splits(spark):
    rows = [(4e-8, "a - b", "t", "http://x/EFO_1"), (5e-8, "c", "t", "http://x/EFO_1"), (1e-9, "A", "u", "http://x/EFO_1"), (1e-9, "d", "t", "http://x/EFO_1, http://x/EFO_2"), (float("nan"), "e", "t", "http://x/EFO_1"), (1e-9, None, "t", "http://x/EFO_1")]
    out = V.normalize_gwas(spark.createDataFrame(rows, "`P-VALUE` double, MAPPED_GENE string, MAPPED_TRAIT string, MAPPED_TRAIT_URI string"))
    assert {(r["gene"], r["trait"], r["p_value"]) for r in out.collect()} == {("A", "u", 1e-9), ("B", "t", 4e-8)}


def test_somatic_scores_never_win(spark):
    targets = spark.createDataFrame([("T1", "S1")], "id string, approvedSymbol string")
    rows = spark.createDataFrame([("eva", "T1", "EFO_1", 0.4), ("eva_somatic", "T1", "EFO_1", 0.9), ("eva", "T1", "EFO_2", 0.6), ("orphanet", "T1", "EFO_2", 0.1)], "datasourceId string, targetId string, diseaseId string, score double")
    assert [(r["efo_id"], r["ot_score"], r["source"]) for r in V.normalize_associations(rows, targets).collect()] == [("EFO:2", 0.6, "eva&orphanet")]
    assert V.normalize_associations(rows, targets, somatic=True).count() == 2
    renamed = rows.withColumnsRenamed({"datasourceId": "aggregationValue", "score": "associationScore"})
    assert V.normalize_associations(renamed, targets).count() == 1


def test_status(spark):
    df = spark.createDataFrame([("Completed",), (None,), ("Withdrawn",), ("Suspended",)], "status string")
    assert {(r[0], r[1]) for r in S.resolve_status(df, S.LABELS, S.LABELS_DROPPED).collect()} == {("Completed", True), (None, True), ("Suspended", False)}
    with pytest.raises(Exception, match="unknown status"):
        S.resolve_status(df, S.CODES | {None: True}, ()).collect()
    with pytest.raises(ValueError, match="unknown values"):
        S.assert_known(df, "status", ["Completed"])


def test_choice_of_dataset(spark):
    with pytest.raises(ValueError):
        N.choose_dataset()
    with pytest.raises(ValueError):
        N.choose_dataset(reports=spark.range(1))


def test_ongoing_needs_both_sources(spark):
    gene_drug = spark.createDataFrame([("G", "d", "A")], "gene string, our_drug_id string, source string")
    records = spark.createDataFrame([("d", "E1", 2, 2, "X"), ("d", "E1", 3, None, "Y"), ("d", "E2", 4, None, "Y")], "our_drug_id string, efo_id string, phase int, phase_concluded int, source string")
    out = {r["efo_id"]: r for r in A.gene_indication_max_phase(gene_drug, records).collect()}
    assert out["E1"]["is_ongoing"] and out["E1"]["drug_indication_sources"] == "X&Y" and not out["E2"]["is_ongoing"]


def test_gzipped_tsv_with_comments(spark, tmp_path):
    import gzip

    path = str(tmp_path / "x.tsv.gz")
    with gzip.open(path, "wt") as f:
        f.write("# note\ngene\tscore\nA\t1\nB\t\n")
    out = scans.scan_tsv(spark, path, comment="#")
    assert [tuple(r) for r in out.collect()] == [("A", "1"), ("B", None)]


def test_strata_with_a_branch_hold_all_rows(spark):
    from corrobora.plans import analysis

    df = spark.createDataFrame([("G1", "D1", 2, False, True), ("G2", "D1", 1, False, False), ("G3", "D2", 2, False, True), ("G4", "D3", 1, False, False)], "gene string, efo_id string, max_phase int, is_ongoing boolean, has_genetic_evidence boolean")
    got = {r["stratum"]: (r["n_yes"], r["n_no"]) for r in analysis.overlapping_strata(df, spark.createDataFrame([("D1",)], "id string")).filter("phase_from = 1 AND phase_to = 2").collect()}
    assert got == {"with": (2, 2), "without": (1, 1)}


def test_only_wanted_tables_are_computed(spark, monkeypatch):
    edges = {"chembl": spark.createDataFrame([("G", "C1", "a", "X")], "gene string, chembl_id string, drug_name string, action_type string")}
    records = {"opentargets": spark.createDataFrame([("C1", "a", "E", 2, True)], "chembl_id string, drug_name string, efo_id string, phase int, is_concluded boolean")}
    whole = A.aggregate_trials(edges, records)
    assert tuple(whole) == A.TABLES
    for name in A.TABLES:
        alone = A.aggregate_trials(edges, records, wanted=(name,))
        assert list(alone) == [name] and alone[name].collect() == whole[name].collect() and alone[name].count() == 1
    monkeypatch.setattr(A, "drug_indication_records", None)
    assert A.aggregate_trials(edges, records, wanted=("gene_drug_mapping",))["gene_drug_mapping"].count() == 1
    with pytest.raises(ValueError, match="unknown tables"):
        A.aggregate_trials(edges, records, wanted=("x",))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_records_are_joined_once_for_all_legs(spark):
    from corrobora.plans import feeds
    from corrobora.plans.inputs import frame

    _, records = feeds.legs(lambda n: frame(spark, "/root/testdata/sf0.001", n))
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in records.values())


def test_programmes_are_few_before_ids_are_replaced(spark, monkeypatch):
    """The crosswalk's ids are replaced, not those of the rows that it multiplies."""
    seen, replace = [], N.current
    monkeypatch.setattr(N, "current", lambda df, release: (seen.append(df.count()), replace(df, release))[1])
    raw = spark.createDataFrame([(f"G{k % 2}", f"M{k % 3}", k % 5 + 1, ("Phase", "Launched", None)[k % 3]) for k in range(300)] + [("G0", None, 5, None), ("G0", "M9", 5, None)], "gene string, indication_mesh_id string, ccatnum int, acat string")
    crosswalk = spark.createDataFrame([("M0", "E:1"), ("M0", "E:2"), ("M1", "E:2"), ("M2", "E:gone"), ("M2", "E:new")], "mesh_id string, efo_id string")
    release = spark.createDataFrame([("E:1", "E:new")], "id string, successor string"), spark.createDataFrame([("E:1",), ("E:gone",)], "id string")
    out = {(r["gene"], r["efo_id"]): tuple(r[2:]) for r in N.programmes(raw, crosswalk, release=release).collect()}
    assert seen == [5]
    assert out == {("G0", "E:new"): (4, 4, False), ("G1", "E:new"): (4, 4, False), ("G0", "E:2"): (4, 4, False), ("G1", "E:2"): (4, 4, False)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["r6_ongoing_rule", "n15_normalize_clinical_reports"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    """What a task holds stays the same: more rows are more tasks, also beyond Spark's number of partitions, and the same result."""
    from corrobora import storage
    from corrobora.plans import feeds

    run = lambda: feeds.QUERIES[name](spark, "/root/testdata/sf0.001")
    plain = sorted(map(repr, run().collect()))
    monkeypatch.setattr(storage, "TASK_ROWS", 300, raising=False)
    many = run()
    filled = many.select(F.spark_partition_id().alias("p")).distinct().count()
    assert filled > 12 and sorted(map(repr, many.collect())) == plain


def test_pairs_of_the_newer_layout(spark):
    """pairs has the pairs of the whole tables, moves no names, and an unknown status stays an error."""
    moa = spark.createDataFrame([(["C1", "C2"], ["T1", "T2"], "x", [("s",), (None,)]), (["C1"], ["T1"], "y", [("r",)])], "chemblIds array<string>, targets array<string>, actionType string, references array<struct<source:string>>")
    labels = "array<struct<label:string>>"
    molecules = spark.createDataFrame([("C1", "one", "a", [], []), ("C1", "one", "a", [], [("z",)])], f"id string, name string, drugType string, synonyms {labels}, tradeNames {labels}")
    targets = spark.createDataFrame([("T1", "G1", []), ("T2", "", [])], "id string, approvedSymbol string, targetClass array<struct<label:string,level:string>>")
    schema = "source string, clinicalStage string, phaseFromSource string, trialOverallStatus string, trialStudyType string, qualityControls array<string>, drugs array<struct<drugId:string>>, diseases array<struct<diseaseId:string>>"
    rows = [("r", "PHASE_1", None, "COMPLETED", None, None, [("C1",), ("C1",), (None,)], [("E_1",), ("E_1",), ("E_2",)]), ("r", "PHASE_2", None, None, None, None, [("C3",)], [("E_1",), (None,)]), ("r", "IND", None, None, None, None, [("C9",)], [("E_9",)]), ("r", "PHASE_1", None, "odd", None, None, [], [("E_1",)])]
    give = lambda r, **more: N.choose_dataset(reports=spark.createDataFrame(r, schema), moa=moa, molecules=molecules, targets=targets, **more)
    genes, found = give(rows)
    assert sorted(map(tuple, found.select("chembl_id", "efo_id", "drug_name").collect())) == [("C1", "E:1", "one"), ("C1", "E:2", "one"), ("C3", "E:1", None)]
    assert {r["action_type"]: r["subsource"] for r in genes.filter("chembl_id = 'C1'").collect()} == {"x": "s", "y": "r"}
    few_genes, few = give(rows, pairs=True)
    assert sorted(map(tuple, few.collect())) == [("C1", "E:1"), ("C1", "E:2"), ("C3", "E:1")] and sorted(map(tuple, few_genes.collect())) == [("G1", "C1"), ("G1", "C2")]
    with pytest.raises(Exception, match="unknown status: odd"):
        give([*rows, ("r", "PHASE_1", None, "odd", None, None, [("C1",)], [("E_1",)])], pairs=True)[1].collect()


def test_drugs_are_made_distinct_once(spark, monkeypatch):
    """The records of all legs are read once for drug identity, and what is written of them are the distinct names, not the clustered records."""
    written, write = [], A.materialise
    monkeypatch.setattr(A, "materialise", lambda df: (lambda out: (written.append(out.columns), out)[1])(write(df)))
    edges = {"chembl": spark.createDataFrame([("G1", "C1", "one"), ("G1", "C1", "one")], "gene string, chembl_id string, drug_name string"), "dgidb": spark.createDataFrame([("G2", " One ")], "gene string, drug_name string")}
    out = A.aggregate_trials(edges, {}, wanted=("gene_drug_mapping",))["gene_drug_mapping"]
    assert sorted((r["gene"], r["our_drug_id"]) for r in out.collect()) == [("G1", "chembl_id:C1"), ("G2", "chembl_id:C1")]
    assert ["record_id" in c for c in written] == [True, False] and not any("drug_cluster" in c for c in written)
