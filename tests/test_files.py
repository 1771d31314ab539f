"""Record files, discovery in folders, sets of tables that are written as one."""

import pytest
from pyspark.sql import functions as F

from corrobora.operators import aggregate as A
from corrobora.operators import ontology as O
from corrobora.plans import analysis
from corrobora.sources import scans

HEADER = "format-version: 1.2\ndata-version: http://x.org/efo/releases/v3.90.0/efo.obo\n"
TERMS = "".join(f"[Term]\nid: X:{k}\nname: term {k}: a [b]\ndef: \"[no stanza]\" \\\n  folded {k}\n{'is_obsolete: true' if k % 5 == 0 else f'is_a: X:{k // 2} ! parent'}\n" + ("\n" if k % 3 else "") for k in range(1, 400)) + "[Typedef]\nid: part_of\nname: part of\n"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ontology_files_of_either_line_end_and_in_parts(spark, tmp_path, end):
    path = tmp_path / "o.obo"
    path.write_bytes((HEADER + "\n" + TERMS).replace("\n", end).encode())
    rows = {r["id"]: r for r in O.scan_terms(spark, str(path)).collect()}
    assert len(rows) == 399 and rows["X:7"]["name"] == "term 7: a [b]" and rows["X:7"]["is_a"] == ["X:3"] and rows["X:10"]["is_obsolete"]
    assert [r["version"] for r in O.scan_version(spark, str(path)).collect()] == ["3.90.0"]
    whole = sorted(r["value"] for r in O.scan_stanzas(spark, str(path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parts = O.scan_stanzas(spark, str(path))
        assert parts.rdd.getNumPartitions() > 5 and sorted(r["value"] for r in parts.collect()) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_file_may_begin_with_a_stanza(spark, tmp_path):
    (tmp_path / "o.obo").write_text("[Term]\nid: A:1\nname: one\n[Term]\nid: A:2\nname: two")
    assert sorted(tuple(r) for r in O.scan_terms(spark, f"{tmp_path}/o.obo").select("id", "name").collect()) == [("A:1", "one"), ("A:2", "two")]
    assert O.scan_version(spark, f"{tmp_path}/o.obo").collect() == []


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_variant_and_descriptor_files(spark, tmp_path, end):
    lines = ["##fileformat=VCFv4.1", "#CHROM\tPOS", '1\t5\t.\tA\tC\t.\t.\tCLNDN=a "quoted;CLNSIG=Pathogenic', "2\t6\t.\tA\tC\t.\t.\tCLNREVSTAT=x"]
    (tmp_path / "v.vcf").write_bytes(end.join(lines).encode())
    rows = [tuple(r) for r in scans.scan_variants(spark, f"{tmp_path}/v.vcf").select("pos", "clndn", "clnsig", "clnrevstat").orderBy("pos").collect()]
    assert rows == [(5, 'a "quoted', "Pathogenic", None), (6, None, None, "x")]
    (tmp_path / "m.bin").write_bytes(end.join(["*NEWRECORD", "MN = C04.5", "UI = D1", "", "*NEWRECORD", "MN = D12", "UI = D2"]).encode())
    assert [r["id"] for r in O.mesh_descriptors(scans.scan_records(spark, f"{tmp_path}/m.bin", "*NEWRECORD"), "C04").collect()] == ["D1"]


def legs(spark):
    gd = spark.createDataFrame([("G1", "D1", "aspirin"), ("G2", "D2", "b")], "gene string, chembl_id string, drug_name string")
    di = spark.createDataFrame([("D1", "aspirin", "E:1", 3, True, "Completed")], "chembl_id string, drug_name string, efo_id string, phase int, is_concluded boolean, status string")
    return gd, di


def test_sources_are_found_in_a_folder(spark, tmp_path):
    gd, di = legs(spark)
    gd.write.parquet(f"{tmp_path}/chembl_gene_drug.parquet")
    di.write.parquet(f"{tmp_path}/opentargets_drug_indication.parquet")
    gd.write.parquet(f"{tmp_path}/stranger_gene_drug.parquet")
    (tmp_path / "notes.txt").write_text("x")
    edges, records = scans.discover_folder(spark, f"file://{tmp_path}", list(A.JOIN_KEYS))
    assert list(edges) == ["chembl"] and list(records) == ["opentargets"] and edges["chembl"].count() == 2
    assert list(scans.discover_folder(spark, str(tmp_path))[0]) == ["chembl", "stranger"]
    assert scans.discover_folder(spark, f"{tmp_path}/none") == ({}, {})


def test_six_tables_are_one_commit(spark, tmp_path):
    gd, di = legs(spark)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        A.aggregate_folder(spark, source, out)
    gd.write.parquet(f"{source}/chembl_gene_drug.parquet")
    di.write.parquet(f"{source}/opentargets_drug_indication.parquet")
    with pytest.raises(FileNotFoundError):
        scans.scan_set(spark, out)
    first = A.aggregate_folder(spark, source, out)
    tables = scans.scan_set(spark, out)
    assert sorted(tables) == ["drug_id_mapping", "drug_indication_mapping", "drug_indication_mapping_by_source", "gene_drug_mapping", "gene_drug_mapping_by_source", "gene_indication_max_phase"]
    assert [(r["gene"], r["efo_id"], r["max_phase"]) for r in tables["gene_indication_max_phase"].collect()] == [("G1", "E:1", 3)]
    # A writer that fails at its second table leaves the first set in force.
    bad = spark.range(1).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        scans.sink_set({"gene_drug_mapping": gd, "other": bad}, out)
    assert scans.current_version(spark, out) == first and len(scans.scan_set(spark, out)) == 6
    second = scans.sink_set({"only": gd}, out)
    assert second > first and list(scans.scan_set(spark, out)) == ["only"]


def test_prior_art_arms_and_published_counts(spark):
    trials = spark.createDataFrame([("G1", "E:1", 4, True), ("G2", "E:1", 1, True), ("G3", "E:2", 4, False), ("G4", "X:1", 4, False)], "gene string, efo_id string, max_phase int, is_ongoing boolean")
    scored = spark.createDataFrame([("G1", "E:1", 0.6), ("G2", "E:1", 0.4)], "gene string, efo_id string, score double")
    lost = spark.createDataFrame([("G9", "E:9", 0.9)], "gene string, efo_id string, score double")
    evidence = analysis.prior_art_evidence(scored, lost, scored.select("gene", "efo_id"))
    branch = spark.createDataFrame([("X:1",)], "id string")
    out = analysis.with_published(analysis.prior_art(trials, evidence, branch, "targets"))
    rows = {r["targets"]: r for r in out.collect()}
    cell = lambda r: (r["x_yes"], r["n_yes"], r["x_no"], r["n_no"])
    assert {n: cell(r) for n, r in rows.items()} == {"credible sets": (1, 1, 1, 2), "direct": (0, 0, 2, 3), "combined": (1, 2, 1, 1), "published": (242, 742, 4322, 36635)}
    assert rows["published"]["rr"] == pytest.approx(2.7645, abs=1e-4) and rows["published"]["or"] == pytest.approx(3.6186, abs=1e-4)


def test_a_scope_clears_what_was_materialised_in_it(spark):
    from corrobora import storage

    fs = lambda path: scans.file_system(spark, path)
    there = lambda path: fs(path)[0].exists(fs(path)[1])
    outside = storage.materialise(spark.range(3))
    with pytest.raises(KeyError), storage.scope(spark):
        inside = storage.materialise(spark.range(5))
        assert inside.count() == 5 and there(inside.inputFiles()[0])
        raise KeyError("lost")
    assert not there(inside.inputFiles()[0]) and outside.count() == 3 and not storage._SCOPES
